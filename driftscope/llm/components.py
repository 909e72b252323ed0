"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftscope.llm.scratch import Scratch


def _stars(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours of each node to the smallest of node and neighbours.

    The smallest neighbour is a minimum that combines before the shuffle; the
    join that brings it back can be split where a node has very many links.
    """
    if larger:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = pairs
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = both.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    own = least.select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).where("u <> v").distinct()


def components(scratch: Scratch, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node with a link; the root is the component's smallest node.

    ``links`` has two columns of whole numbers; their order and repeats don't
    matter.  Each round is a written table; rounds stop when the links no longer
    change, which takes about the logarithm of the largest component.
    """
    a, b = links.columns
    now = scratch.keep(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links-0")

    def state(df: DataFrame) -> tuple:
        # exact sums: equal rows give equal sums, and a step never returns to an earlier state
        return tuple(df.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")),
                            F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first())

    before, turn = state(now), 0
    while before[0]:
        turn += 1
        if turn > max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        now = scratch.keep(_stars(_stars(now, True), False), f"links-{turn}")
        after = state(now)
        scratch.drop(f"links-{turn - 1}")
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
