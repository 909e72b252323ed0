"""Tables in buckets of their key: a batch of changes reads and rewrites only the buckets it touches."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftscope.folders import remove
from driftscope.operators.changes import matching, update_by_key, without

BUCKET = "key_bucket"


class BucketTable:
    """The table below ``path``, one folder per bucket of ``key``.

    ``key`` need not be unique: a child table is kept by its parent's key.
    ``schema`` is that of its rows, so that a table that lost all of them can
    still be read.  The driver sees numbers of buckets, at most ``buckets``.

    A change replaces folder after folder once all new files are written.
    Setting values and deleting give the same table when repeated, so after a
    failure in between the same batch is applied again.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = 256):
        if buckets < 1:
            raise ValueError("buckets must be at least 1")
        if BUCKET in schema.names:
            raise ValueError(f"a table's column cannot be named {BUCKET}")
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        fields = [*self.schema.fields, T.StructField(BUCKET, T.IntegerType())]
        return self.spark.read.schema(T.StructType(fields)).parquet(self.path)

    def _write(self, rows: DataFrame, mode: str) -> None:
        # few files per bucket, and several tasks for a bucket of many rows
        rows.hint("rebalance", BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(
            BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> BucketTable:
        self._write(rows.select(*self.schema.names).withColumn(BUCKET, self._bucket()), "error")
        return self

    def add(self, rows: DataFrame) -> None:
        """Append rows, in files of their own; a repeated call adds them again."""
        self._write(rows.select(*self.schema.names).withColumn(BUCKET, self._bucket()), "append")

    def rows(self) -> DataFrame:
        return self._stored().select(*self.schema.names)

    def touched(self, requests: DataFrame) -> list[int]:
        """The buckets that the requests' keys lie in.  A missing key lies in none."""
        known = requests.where(F.col(self.key).isNotNull())
        return sorted(r[0] for r in known.select(self._bucket()).distinct().collect())

    def part(self, requests: DataFrame) -> DataFrame:
        """The rows of the touched buckets, with their bucket; others are not listed by the scan."""
        return self._stored().where(F.col(BUCKET).isin(self.touched(requests)))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is among ``keys``."""
        return matching(self.part(keys), keys, self.key).select(*self.schema.names)

    def _rewrite(self, requests: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        self._write(change(self.part(requests)), "overwrite")

    def update(self, requests: DataFrame, sequence: str, values: Mapping[str, str]) -> None:
        """As :func:`driftscope.operators.changes.update_by_key`; the key itself stays."""
        if self.key in values:
            raise ValueError("an update cannot change the key")
        self._rewrite(requests, lambda rows: update_by_key(rows, requests, self.key, sequence, values))

    def delete(self, keys: DataFrame) -> None:
        """Drop the rows with these keys.

        No new file replaces a bucket that loses all its rows, so its folder is
        removed; which ones those are is found from the key column alone.
        """
        touched = self.touched(keys)
        left = without(self.part(keys).select(self.key, BUCKET), keys, self.key)
        kept = {r[0] for r in left.select(BUCKET).distinct().collect()}
        self._rewrite(keys, lambda rows: without(rows, keys, self.key))
        for bucket in touched:
            if bucket not in kept:
                remove(self.spark, f"{self.path}/{BUCKET}={bucket}")


def delete_cascade_in_place(keys: DataFrame, parent: BucketTable, *children: BucketTable,
                            grandchildren: tuple[tuple[BucketTable, BucketTable], ...] = ()) -> None:
    """Delete parents with all that hangs on them, the farthest first.

    ``grandchildren`` pairs a table with the child it hangs on.  The child holds
    the table's key as well as the parent's, and is itself among ``children``.
    If it fails in between, parents are still there to start again from.
    """
    for table, child in grandchildren:
        table.delete(child.lookup(keys).select(table.key))
    for child in children:
        child.delete(keys)
    parent.delete(keys)
