"""Folders of shared storage, through Hadoop's file system, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def present(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.exists(p))


def whole(spark: SparkSession, path: str) -> bool:
    """Was the table in this folder written to its end?"""
    return present(spark, f"{path}/_SUCCESS")


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is absent."""
    fs, p = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def removed(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
