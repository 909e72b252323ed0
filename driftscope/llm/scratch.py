"""Written intermediate tables, in the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftscope.session import work_dir


class Scratch:
    """Tables of one operator call below ``spark.checkpoint.dir``.

    A table that is written and read back cuts the lineage, is computed once
    and survives lost executors.  What the returned frame still reads stays
    until the folder is cleared; ``drop`` removes what is no longer read.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.path = spark, work_dir(spark, purpose)
        ship_package(spark)

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write a table, in one folder per value of ``by``, and read it back."""
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def keep_in_buckets(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """The same, dealt into as many sorted buckets as a shuffle has partitions: joins on ``by`` need not move it."""
        table, n = f"{name}_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("path", f"{self.path}/{name}").bucketBy(n, *by).sortBy(*by).saveAsTable(table)
        kept = self.spark.table(table)
        # the frame knows the files and buckets; the catalog need not
        self.spark.sql(f"DROP TABLE {table}")
        return kept

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def positions(scratch: Scratch, df: DataFrame, order: list[str], name: str = "position", weight: str | None = None,
              table: str = "ordered") -> DataFrame:
    """Add the number of rows (or the sum of ``weight``) before each row in the order of ``order``.

    Rows are dealt into ranges of the order, written with the number of their
    range, and counted inside it; one row per range is summed up in one task.
    ``order`` should tell rows apart: equal rows are counted in any order.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.keep(df.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()), table)
    amount = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    ranges = dealt.groupBy("_range").agg(F.sum(amount).alias("_rows"))
    so_far = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_rows").over(so_far), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(
        ranges, "_range").withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint")).drop(
        "_inside", "_before", "_range")


def give_back_memory() -> None:
    """Return freed memory of this process to the system, at the end of a partition: workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@lru_cache(maxsize=4)
def _ship(application: str) -> None:
    root = Path(__file__).resolve().parents[2]
    if str(root) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/driftscope", "zip", root, "driftscope")
        SparkContext.getOrCreate().addPyFile(archive)


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, unless they are told where it lies."""
    _ship(spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_interval(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts: the first 52 bits of an MD5 digest, which SQL can repeat."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
