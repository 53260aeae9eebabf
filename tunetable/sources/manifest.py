"""Manifest sources (S1, S2): one utterance per line, ``path<sep>text``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import col_of


def parse_manifest(lines: DataFrame, line_col: str = "value", sep: str = "|",
                   keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Split lines at the first ``sep``: (parsed, rejects).

    ``parsed`` has ``audio_path`` (first field) and ``text`` (the rest, later
    separators kept). A line without a separator (or a null line) is a reject,
    never silently dropped.
    """
    parts = F.split(col_of(line_col), re.escape(sep), 2)
    d = lines.withColumn("__parts", parts)
    ok = F.coalesce(F.size("__parts") == 2, F.lit(False))
    parsed = d.filter(ok).select(*keep, F.col("__parts")[0].alias("audio_path"),
                                 F.col("__parts")[1].alias("text"))
    rejects = d.filter(~ok).select(*keep, col_of(line_col).alias("line"))
    return parsed, rejects


def with_line_numbers(df: DataFrame, file_col: str = "source_file", out: str = "line_no") -> DataFrame:
    """0-based line number of each line within its file, computed without a per-file window.

    Lines of one file split are consecutive in one task, so
    ``monotonically_increasing_id`` minus the split's minimum is the position
    inside the split; the per-split counts (one row per split) are
    prefix-summed per file and added back.
    """
    d = df.withColumn("__mid", F.monotonically_increasing_id())
    splits = d.groupBy(file_col, "__blk").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__min"))
    w = Window.partitionBy(file_col).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    j = d.join(splits.select(file_col, "__blk", "__off", "__min"), [file_col, "__blk"])
    return j.withColumn(out, F.col("__off") + F.col("__mid") - F.col("__min")).drop(
        "__mid", "__off", "__min", "__blk")


def read_manifest(spark: SparkSession, paths, phase: str | None = None, sep: str = "|",
                  ) -> tuple[DataFrame, DataFrame]:
    """Read one or more manifest files: (parsed, rejects).

    Columns: ``phase, source_file, line_no, audio_path, text``. A list of
    paths is read as one source (the concatenation of the files).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("__blk"))
    raw = with_line_numbers(raw)
    raw = raw.withColumn("phase", F.lit(phase).cast("string"))
    return parse_manifest(raw, "value", sep, keep=("phase", "source_file", "line_no"))


def stream_manifest(spark: SparkSession, path: str, phase: str | None = None,
                    sep: str = "|") -> tuple[DataFrame, DataFrame]:
    """Streaming twin of ``read_manifest`` (no line numbers: a stream has no file order)."""
    raw = spark.readStream.text(path).select(
        "value", F.col("_metadata.file_path").alias("source_file"))
    raw = raw.withColumn("phase", F.lit(phase).cast("string"))
    return parse_manifest(raw, "value", sep, keep=("phase", "source_file"))


def union_manifests(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenate manifests (UNION ALL, duplicates kept), by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
