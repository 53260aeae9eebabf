"""Micro-batches with several results, each written under its batch id.

A batch that is run again after a failure has the same id and the same rows
and replaces what it wrote, so every input row counts once in every sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifest import pair_clips
from ..plans.files import listed, whole
from .latency import event_time_utc


def run_batches(stream: DataFrame, fn: Callable[[DataFrame, int], dict[str, DataFrame]], path: str, checkpoint: str) -> None:
    """Write ``fn(batch, batch_id)``'s tables to ``path/<name>/batch-<id>`` for everything available, then stop."""
    def write(batch: DataFrame, batch_id: int) -> None:
        for name, out in fn(batch, batch_id).items():
            out.write.mode("overwrite").parquet(f"{path}/{name}/batch-{batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_batches(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame | None:
    """The whole batches of one sink (those before a batch id), None if there are none."""
    ids = sorted(int(n.split("-")[1]) for n in listed(spark, f"{path}/{name}") if n.startswith("batch-"))
    paths = [f"{path}/{name}/batch-{i}" for i in ids if (before is None or i < before) and whole(spark, f"{path}/{name}/batch-{i}")]
    return spark.read.schema(spark.read.parquet(paths[0]).schema).parquet(*paths) if paths else None


def pair_stream(manifest: DataFrame, clips: DataFrame, path: str, checkpoint: str) -> None:
    """J1 on a stream of manifest lines: sinks ``paired`` and ``missing``; a line is in exactly one of them."""
    def both(batch: DataFrame, _batch_id: int) -> dict[str, DataFrame]:
        paired, missing = pair_clips(batch, clips)
        return {"paired": paired, "missing": missing}

    run_batches(manifest, both, path, checkpoint)


def latency_with_rejects(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", seconds: str = "seconds",
                         window: str = "1 day", lateness: str = "1 hour") -> None:
    """ST2 with its late rows: sinks ``windows`` (partial sums of a batch's windows) and ``late`` (whole rows).

    The watermark of a batch is the greatest event time of the batches before
    it, less ``lateness``; it is state in the sink ``marks``, one row a batch. A
    row older than the watermark of its batch goes to ``late`` instead of being
    dropped: kept and late rows together are the input. Rows without an event
    time are late too.
    """
    def split(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        spark = batch.sparkSession
        marks = read_batches(spark, path, "marks", before=batch_id)
        greatest = marks.agg(F.max("mark")).first()[0] if marks is not None else None
        at = event_time_utc(ts) if batch.schema[ts].dataType.simpleString() == "timestamp_ntz" else F.col(ts)
        rows = batch.withColumn("__at", at)
        early = F.col("__at") < F.lit(greatest).cast("timestamp") - F.expr(f"INTERVAL {lateness}") if greatest is not None else F.lit(False)
        late = F.col("__at").isNull() | early
        kept = rows.filter(~late).groupBy(F.window("__at", window).alias("w")).agg(F.count(F.lit(1)).alias("n_requests"), F.sum(seconds).alias("total_seconds"))
        return {"windows": kept.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_requests", "total_seconds"),
                "late": rows.filter(late).drop("__at"), "marks": rows.agg(F.max("__at").alias("mark"))}

    run_batches(stream, split, path, checkpoint)


def latency_windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows of all batches so far, added up."""
    t = read_batches(spark, path, "windows")
    return t.groupBy("window_start", "window_end").agg(F.sum("n_requests").alias("n_requests"), F.sum("total_seconds").alias("total_seconds"))
