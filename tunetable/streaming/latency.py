"""Tumbling latency windows (ST2): batch form and streaming form share one definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time_utc(ts) -> "F.Column":
    """Event time as an instant, independent of the session time zone.

    A TIMESTAMP_NTZ wall-clock value is read as UTC (through its text plus
    ``Z``), never through the session zone; a TIMESTAMP is kept as is.
    Watermarks need this type, and windows then align to UTC days.
    """
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.concat(c.cast("string"), F.lit("Z")).cast("timestamp")


def utc_text(ts) -> "F.Column":
    """``yyyy-MM-dd HH:mm:ss`` of an instant in UTC, whatever the session zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    secs = F.unix_seconds(c)
    day = F.date_from_unix_date(F.floor(secs / 86400).cast("int"))
    tod = F.pmod(secs, F.lit(86400))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit(" "), two(F.floor(tod / 3600)), F.lit(":"),
                    two(F.floor(F.pmod(tod, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(tod, F.lit(60))))


def _agg(df: DataFrame, ts: str, seconds: str, window: str) -> DataFrame:
    return (df.groupBy(F.window(F.col(ts), window).alias("w"))
            .agg(F.count(F.lit(1)).alias("n_requests"), F.sum(seconds).alias("total_seconds"))
            .withColumn("mean_seconds", F.col("total_seconds").cast("double") / F.col("n_requests"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "n_requests", "total_seconds", "mean_seconds"))


def _is_ntz(df: DataFrame, ts: str) -> bool:
    return df.schema[ts].dataType.simpleString() == "timestamp_ntz"


def latency_tumbling(df: DataFrame, ts: str = "ts", seconds: str = "seconds", window: str = "1 day") -> DataFrame:
    """Batch twin: count, total and mean seconds per tumbling window (window bounds are instants)."""
    d = df.withColumn(ts, event_time_utc(ts)) if _is_ntz(df, ts) else df
    return _agg(d, ts, seconds, window)


def latency_stream(df: DataFrame, ts: str = "ts", seconds: str = "seconds", window: str = "1 day",
                   lateness: str = "1 hour") -> DataFrame:
    """Streaming form: watermark on event time, results appended once a window closes."""
    d = df.withColumn(ts, event_time_utc(ts)) if _is_ntz(df, ts) else df
    return _agg(d.withWatermark(ts, lateness), ts, seconds, window)


def run_latency_stream(spark, source_dir: str, out_path: str, checkpoint: str, glob: str = "events.parquet",
                       ts: str = "ts", seconds: str = "value", window: str = "1 day",
                       lateness: str = "1 hour") -> None:
    """Run the windowed latency metric over a Parquet stream until it has read
    everything available, appending each closed window to ``out_path``.

    Append mode: a window is written once, after the watermark has passed its
    end, and its state is dropped then. Windows still open stay in the
    checkpoint, from which a later run goes on.
    """
    schema = spark.read.option("pathGlobFilter", glob).parquet(source_dir).schema
    src = (spark.readStream.schema(schema).option("pathGlobFilter", glob)
           .parquet(source_dir)
           .select(F.col(ts), F.col(seconds).cast("decimal(18,2)").alias("seconds")))
    agg = latency_stream(src, ts, "seconds", window, lateness)
    q = (agg.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(out_path))
    q.awaitTermination()
