"""Folders of any file system that Spark can write to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def is_there(spark: SparkSession, path: str) -> bool:
    system, place = _open(spark, path)
    return system.exists(place)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    system, place = _open(spark, path)
    return [entry.getPath().getName() for entry in system.listStatus(place) if entry.isDirectory()]


def touch(spark: SparkSession, path: str) -> None:
    system, place = _open(spark, path)
    system.create(place, True).close()


def remove(spark: SparkSession, path: str) -> None:
    system, place = _open(spark, path)
    system.delete(place, True)
