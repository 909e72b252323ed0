"""Which of two databases is the baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN_DATABASE"


@dataclass(frozen=True)
class Sides:
    """Names and compatibility levels of the baseline and the candidate."""

    low_db: str
    high_db: str
    low_level: int
    high_level: int

    @property
    def low_label(self) -> str:
        return f"CL{self.low_level}"

    @property
    def high_label(self) -> str:
        return f"CL{self.high_level}"


def order_pairs(databases: DataFrame, pairs: DataFrame) -> DataFrame:
    """Resolve many (db_a, db_b) pairs at once.

    The smaller level is the baseline, and A is on a tie.  A pair with a name
    that ``databases`` (name, compatibility_level) does not know keeps its row,
    with the status telling so.
    """
    level = databases.select("name", F.col("compatibility_level").cast("int").alias("level"))
    a = level.select(F.col("name").alias("db_a"), F.col("level").alias("level_a"))
    b = level.select(F.col("name").alias("db_b"), F.col("level").alias("level_b"))
    known = pairs.join(a, "db_a", "left").join(b, "db_b", "left")
    complete = F.col("level_a").isNotNull() & F.col("level_b").isNotNull()
    a_first = F.col("level_a") <= F.col("level_b")

    def pick(first: str, second: str):
        return F.when(complete, F.when(a_first, F.col(first)).otherwise(F.col(second)))

    low, high = pick("level_a", "level_b"), pick("level_b", "level_a")
    return known.select(
        *pairs.columns,
        pick("db_a", "db_b").alias("low_db"),
        pick("db_b", "db_a").alias("high_db"),
        low.alias("low_level"),
        high.alias("high_level"),
        F.concat(F.lit("CL"), low.cast("string")).alias("low_label"),
        F.concat(F.lit("CL"), high.cast("string")).alias("high_label"),
        F.when(complete, F.lit("OK")).otherwise(F.lit(UNKNOWN)).alias("status"),
    )


def resolve_sides(databases: DataFrame, db_a: str, db_b: str) -> Sides:
    """Resolve one pair; the values become literals and labels of later plans."""
    spark = databases.sparkSession
    pair = spark.createDataFrame([(db_a, db_b)], "db_a string, db_b string")
    row = order_pairs(databases, pair).first()
    if row is None or row["status"] != "OK":
        raise ValueError(f"no compatibility level known for {db_a!r} or {db_b!r}")
    return Sides(row["low_db"], row["high_db"], row["low_level"], row["high_level"])
