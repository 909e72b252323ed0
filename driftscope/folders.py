"""Folders of the shared file system, whichever Spark reads them through."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def numbered(spark: SparkSession, path: str, name: str, finished: bool = False) -> list[int]:
    """The numbers of the folders ``name=…`` below ``path``; ``finished``: of those with Spark's mark of success."""
    system, pattern = _place(spark, f"{path}/{name}=*" + ("/_SUCCESS" if finished else ""))
    folders = [found.getPath().getParent() if finished else found.getPath() for found in system.globStatus(pattern) or ()]
    return sorted(int(folder.getName().rpartition("=")[2]) for folder in folders)


def remove(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.delete(place, True)
