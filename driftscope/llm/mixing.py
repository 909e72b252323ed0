"""Mixing sources to target weights, as DataFrame expressions only.

Words are added up per source, a target is derived for each, and a document is
emitted floor(rate) times plus one more copy with probability equal to the
fraction, where rate is target / size of its source.  The chance of a document
comes from a hash of seed and id, so reruns agree.

Sources in code point order, a null source last, take the weights in turn and
share all words by them.  A target stops at ``limit`` times its source's words
and the excess goes to the others by weight, until none is above.  The level at
which that settles is the zero of a concave piecewise linear function; each
Newton step is one aggregate over the table of sources, and few are needed.

Null texts have no words.  A source without words has target 0 and its documents
are not emitted.  Rows with equal ids share one chance, and a null id counts as
an empty text.  Input columns named like an added one are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftscope.llm.scratch import Scratch, positions, unit_interval

WORD = r"[^\x20\x09-\x0D]+"
LIMIT = 3


def words(text: Column) -> Column:
    """The number of words in a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1),
                   limit: int = LIMIT) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = positions(scratch, totals.withColumn("none", F.col("source").isNull()), ["none", "source"],
                         table="sources-ordered")
    turn = (F.col("position") % len(weights) + 1).cast("int")
    sources = scratch.keep(numbered.select("source", "source_size", F.element_at(
        F.array(*map(F.lit, weights)), turn).cast("bigint").alias("w")), "sources")

    def wide(x) -> Column:
        return (x if isinstance(x, Column) else F.lit(x)).cast("decimal(19,0)")

    total, weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    fixed = 0
    while True:
        stopped = wide(total - fixed) * F.col("w") > wide(F.col("source_size") * limit) * wide(weight)
        now = sources.agg(F.coalesce(F.sum(F.when(stopped, F.col("source_size") * limit)), F.lit(0)),
                          F.coalesce(F.sum(F.when(~stopped, F.col("w"))), F.lit(0))).first()
        if (fixed, weight) == tuple(now):
            break
        fixed, weight = now
    share = (F.lit(total - fixed).cast("bigint") * F.col("w")).cast("double") / F.lit(float(weight or 1))
    return sources.select("source", "source_size", F.when(stopped, (F.col("source_size") * limit).cast("double"))
                          .otherwise(share).alias("target"))


def with_copies(docs: DataFrame, targets: DataFrame, id_column: str = "doc_id", source_column: str = "source",
                seed: int = 42) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``copies``, the times a row is emitted."""
    rate = targets.select(F.col("source").alias("__source"), F.col("source_size").alias("__size"),
                          F.col("target").alias("__target"))
    joined = docs.withColumn("__of", F.col(source_column)).join(rate, F.col("__of").eqNullSafe(F.col("__source")))
    times = F.when(F.col("__size") > 0, F.col("__target") / F.col("__size")).otherwise(F.lit(0.0))
    chance = unit_interval(F.lit(seed), F.col(id_column))
    copies = F.floor(times) + F.when(chance < times - F.floor(times), 1).otherwise(0)
    return joined.withColumns({"copies": copies.cast("bigint"), "source_size": F.col("__size"),
                               "target": F.col("__target")}).drop("__of", "__source", "__size", "__target")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), limit: int = LIMIT, seed: int = 42) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as its source's rate asks for, with the columns of ``docs``."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = docs.select(F.col(source_column).alias("source"), words(F.col(text_column)).alias("size"))
    targets = scratch.keep(source_targets(scratch, sizes, weights, limit), "targets")
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)],
                        F.col(id_column).alias("__id"), F.col(source_column).alias("__src"))
    counted = with_copies(plain, targets, "__id", "__src", seed)
    emitted = counted.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return emitted.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
