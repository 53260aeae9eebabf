"""Running row-local operators on a stream: the same DataFrame function, a streaming source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stream_parquet(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream a Parquet directory, or one file.

    A path's last name is given as a pattern that it alone matches: Spark then
    takes what it finds there, a file or a directory, in any store it can read.
    """
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    head, slash, name = path.rstrip("/").rpartition("/")
    return r.parquet(f"{head}{slash}{name[:-1]}[{name[-1]}]")


def run_available(df: DataFrame, fn: Callable[[DataFrame], DataFrame], sink_path: str,
                  checkpoint: str, fmt: str = "parquet") -> None:
    """Apply ``fn`` to a streaming DataFrame and write everything available, then stop.

    The checkpoint makes the run restartable after a failure.
    """
    q = (fn(df).writeStream.format(fmt).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink_path))
    q.awaitTermination()
