"""Corpus, request and object-listing sources (S3, S7, S8) and the metrics sink."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.files import listed, whole


def read_corpus(spark: SparkSession, source: str, fmt: str = "parquet",
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Named raw-text corpus as ``(doc_id, text)``.

    Parquet keeps its ids; a plain text source gets the line number as id.
    """
    if fmt == "parquet":
        return spark.read.parquet(source).select(F.col(id_col).alias("doc_id"),
                                                 F.col(text_col).alias("text"))
    from .manifest import with_line_numbers
    raw = spark.read.text(source).select(
        "value", F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("__blk"))
    return with_line_numbers(raw, out="doc_id").select("doc_id", F.col("value").alias("text"))


def catalog_objects(spark: SparkSession, root: str, glob: str | None = None,
                    recursive: bool = True) -> DataFrame:
    """List objects under a prefix in place: ``(path, size, mtime)``, contents never read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(root).select("path", F.col("length").alias("size"),
                               F.col("modificationTime").alias("mtime"))


def requests_from(spark: SparkSession, texts: Sequence[str], preset: str | None = None) -> DataFrame:
    """Sentence list to a request table, ids in list order (driver-side list: a small request)."""
    rows = [(i, t, preset) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "request_id long, text string, preset string")


def read_requests(spark: SparkSession, path: str, preset: str | None = None) -> DataFrame:
    """A request list in text files, one sentence a line: ids in the order of file name and line.

    Blank lines are no requests and take no id. Ids depend on the files alone,
    not on how Spark splits them.
    """
    from ..plans.prefix import ranged_index
    from .manifest import with_line_numbers
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("__blk"))
    lines = with_line_numbers(raw, out="__line").filter(F.trim("value") != "")
    return ranged_index(lines.select("source_file", "__line", F.trim("value").alias("text")), ["source_file", "__line"], out="request_id").select(
        "request_id", "text", F.lit(preset).cast("string").alias("preset"))


def write_metrics(df: DataFrame, path: str, partition: str = "run_id", width: int | None = None, job: str | None = None) -> None:
    """Append metric rows as Parquet, partitioned by run.

    With ``width``, directories hold groups of runs (``<partition>_group =
    run div width``) instead of one run each, so many small runs do not turn
    into many tiny directories. ``rebalance`` on the directory column gathers
    each directory's rows into few tasks (few files); AQE splits one that is
    too large for a task and merges small ones.

    ``job`` names what is written. Each call then writes an attempt of its own,
    and ``read_metrics`` sees the last whole attempt of each job only: a run
    that died half-way leaves nothing to read, and one that is done again
    replaces its first rows instead of doubling them.
    """
    col = partition
    if width:
        col = f"{partition}_group"
        df = df.withColumn(col, F.call_function("div", F.col(partition).cast("long"), F.lit(width).cast("long")))
    if job is not None:
        spark = df.sparkSession
        last = max((int(a.split("-")[1]) for a in listed(spark, f"{path}/job-{job}")), default=0)
        path = f"{path}/job-{job}/attempt-{last + 1:09d}-{uuid.uuid4().hex[:8]}"
    df.hint("rebalance", col).write.mode("append").partitionBy(col).parquet(path)


def whole_attempts(spark: SparkSession, path: str) -> list[str]:
    """The folders of the last whole attempt of each job."""
    found = []
    for job in sorted(n for n in listed(spark, path) if n.startswith("job-")):
        done = [a for a in sorted(listed(spark, f"{path}/{job}")) if whole(spark, f"{path}/{job}/{a}")]
        found += [f"{path}/{job}/{a}" for a in done[-1:]]
    return found


def read_metrics(spark: SparkSession, path: str, partition: str = "run_id", width: int | None = None,
                 run=None) -> DataFrame:
    """Read a metrics table; a given run prunes to its directory. Of jobs, the last whole attempt each."""
    if any(n.startswith("job-") for n in listed(spark, path)):
        parts = [spark.read.parquet(p) for p in whole_attempts(spark, path)]
        if not parts:
            raise ValueError(f"no whole attempt in {path}")
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    else:
        df = spark.read.parquet(path)
    if run is not None:
        if width:
            df = df.filter(F.col(f"{partition}_group") == run // width)
        df = df.filter(F.col(partition) == run)
    return df.drop(f"{partition}_group") if width else df
