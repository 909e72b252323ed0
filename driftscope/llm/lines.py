"""Lines that earlier documents hold already, found with levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, in lower case (A-Z).
Keys of ``min_chars`` code points or more stay in the document with the smallest
id that holds them and are lost everywhere else; all other lines stay.

Documents come in batches of ascending ids.  ``LineRuns`` keeps the hashes of all
keys seen so far in runs: tables in buckets of the hash, sorted in each.  A batch
adds up its own keys, merge-anti-joins them with every run, bucket by bucket and
without moving a run, and what is new becomes a run of level 0.  Before a batch is
read, ``fanout`` runs of a level are merged into one of the next, so a key is
written once a level and a batch meets about ``fanout`` runs a level.

A key is told by 128 bits of XXH64 under two seeds.

Whether a line stays depends on its key and its document's id alone, so the
lost places are looked up by both, which spreads a key that a third of all
documents hold over as many tasks as it has ids.

* Null texts and empty texts are one empty line.
* Rows with equal ids are one document: what is first found in one of them stays
  in all of them.  Rows without an id are one document that comes last.
* An empty table gives an empty table.  Columns named like a result are replaced,
  all others are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftscope.llm.scratch import Scratch

SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(value: Column, names: list[str]) -> list[Column]:
    """128 bits: the second hash starts from another seed, so it is no function of the first."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(1), value).alias(names[1])]


class LineRuns:
    """The line hashes seen so far: levels of sorted runs in buckets.

    Runs are tables of the session's catalog with files below the shared folder.
    """

    def __init__(self, scratch: Scratch, fanout: int = 2, buckets: int | None = None):
        self.scratch, self.spark, self.fanout = scratch, scratch.spark, fanout
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.runs, self.levels = f"line_runs_{uuid.uuid4().hex}", 0, [[]]

    def _write(self, rows: DataFrame) -> str:
        table = f"{self.name}_{self.runs}"
        self.runs += 1
        rows.write.format("parquet").option("path", f"{self.scratch.path}/{table}").bucketBy(
            self.buckets, *_HASH).sortBy(*_HASH).saveAsTable(table)
        return table

    def _forget(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.scratch.drop(table)

    def compact(self) -> None:
        """Merge full levels. Runs share no key, so an outer merge join of two is their union, in order."""
        for level, tables in enumerate(self.levels):
            if len(tables) < self.fanout:
                continue
            merged = self.spark.table(tables[0])
            for table in tables[1:]:
                other = self.spark.table(table).withColumnRenamed("first_id", "other_id")
                merged = merged.hint("merge").join(other, _HASH, "full_outer").select(
                    *_HASH, F.coalesce("first_id", "other_id").alias("first_id"))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged))
            for table in tables:
                self._forget(table)
            tables.clear()

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of ``h1, h2, id``; returns ``h1, h2, first_id`` of the keys no batch before had."""
        self.compact()
        new = lines.groupBy(*_HASH).agg(F.min("id").alias("first_id"))
        for table in [t for level in self.levels for t in level]:
            new = new.hint("merge").join(self.spark.table(table).select(*_HASH), _HASH, "left_anti")
        self.levels[0].append(self._write(new))
        return self.spark.table(self.levels[0][-1])

    def seen(self) -> DataFrame:
        """``h1, h2, first_id`` of all keys so far."""
        tables = [self.spark.table(t) for level in self.levels for t in level]
        out = tables[0]
        for table in tables[1:]:
            out = out.unionByName(table)
        return out

    def close(self) -> None:
        """Take the runs out of the catalog; their files stay while the scratch folder does."""
        for level in self.levels:
            for table in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def _bounds(docs: DataFrame, id_column: str, batches: int) -> list:
    """Ids that cut the table into batches of about equal rows, ascending."""
    if batches < 2:
        return []
    parts = [i / batches for i in range(1, batches)]
    return docs.agg(F.percentile_approx(id_column, parts).alias("bounds")).first().bounds or []


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 10,
                        batches: int = 4, fanout: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with the text of the lines that stay, ``n_lines`` (before) and ``n_dropped``.

    Ids are whole numbers.  The batches stand for arrivals: how many there are
    changes the work, not the result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "repeated-lines")
    text, row = F.coalesce(F.col(text_column), F.lit("")), ["t1", "t2"]
    bounds = _bounds(docs, id_column, batches)
    batch = F.lit(0)
    for bound in bounds:
        batch = batch + (F.col("id") > F.lit(bound)).cast("int")
    batch = F.coalesce(batch, F.lit(len(bounds)))
    lines = docs.select(F.col(id_column).alias("id"), *_hashes(text, row), F.posexplode(split_lines(text)).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    keyed = scratch.keep(keyed.select("id", *row, "pos", *_hashes(F.col("key"), _HASH), batch.alias("batch")), "lines",
                         by="batch")
    runs = LineRuns(scratch, fanout)
    for number in range(len(bounds) + 1):
        runs.add(keyed.where(F.col("batch") == number))
    # a key's lines stay where its first id is; all others are lost
    first = runs.seen()
    runs.close()
    one, two = keyed.alias("l"), first.alias("f")
    lost = one.join(two, (F.col("l.h1") == F.col("f.h1")) & (F.col("l.h2") == F.col("f.h2"))
                    & F.col("l.id").eqNullSafe(F.col("f.first_id")), "left_anti")
    lost = lost.groupBy("id", *row).agg(F.sort_array(F.collect_set("pos")).alias("_lost"))
    named = docs.drop("n_lines", "n_dropped").withColumns(
        dict(zip(("_t1", "_t2"), _hashes(text, row))) | {"_id": F.col(id_column)})
    found = named.alias("d").join(lost.alias("g"), F.col("d._id").eqNullSafe(F.col("g.id")) & (
        F.col("d._t1") == F.col("g.t1")) & (F.col("d._t2") == F.col("g.t2")), "left").select("d.*", "g._lost")
    n = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    # what lies between two lost places, from -1 to the end, is cut out as a whole
    # the outer transform has one element, so that the text is split once
    cut = f"""concat_ws('\n', flatten(flatten(transform(array(split(`{text_column}`, '\n')), p -> transform(
              sequence(0, size(_cut) - 2), k -> slice(p, _cut[k] + 2, _cut[k + 1] - _cut[k] - 1))))))"""
    found = found.withColumns({"n_lines": n.cast("bigint"), "_cut": F.concat(
        F.array(F.lit(-1)), F.col("_lost"), F.array(n.cast("int")))})
    return found.withColumns({
        text_column: F.when(F.col("_lost").isNull(), F.col(text_column)).otherwise(F.expr(cut)),
        "n_dropped": F.coalesce(F.size("_lost"), F.lit(0)).cast("bigint")}).drop("_t1", "_t2", "_id", "_lost", "_cut")
