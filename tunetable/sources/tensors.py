"""Tensor tables (S5) and adapters (S6) as Parquet.

A checkpoint is written partitioned by ``run_id`` and ``step``; rewriting
the same (run, step) replaces only that partition (dynamic overwrite), so a
re-run after a lost executor or driver restart is idempotent.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.files import listed, present, removed

TENSOR_SCHEMA = ("tensor string, kind string, row int, ndim int, shape array<int>, "
                 "dtype string, values array<float>")


def checkpoint_table(spark: SparkSession, path: str, buckets: int) -> str:
    """Register the bucketed run/step checkpoint table at ``path`` in this
    session (creating it when new, recovering its partitions otherwise)."""
    import uuid
    name = f"ckpt_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({TENSOR_SCHEMA}, run_id bigint, step int) USING parquet "
              f"PARTITIONED BY (run_id, step) CLUSTERED BY (tensor, row) SORTED BY (tensor, row) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    if present(spark, path):
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name


def write_tensors(df: DataFrame, path: str, run_id: int, step: int, buckets: int | None = None) -> None:
    """Write one (run, step) checkpoint, replacing only that partition.

    With ``buckets``, the checkpoint table is also bucketed and sorted by
    ``(tensor, row)``: two steps (or runs) of it then join on ``(tensor, row)``
    without a shuffle. Rows move to the task that owns their bucket first (a
    shuffle by the table's own hash), so a step has at most one file a bucket.
    """
    if buckets:
        spark = df.sparkSession
        name = checkpoint_table(spark, path, buckets)
        view = f"{name}_in"
        aligned(df.select("tensor", "kind", "row", "ndim", "shape", "dtype", "values"), buckets).createOrReplaceTempView(view)
        spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (run_id = {int(run_id)}, step = {int(step)}) "
                  f"SELECT * FROM {view}")
        spark.catalog.dropTempView(view)
        return
    (df.withColumn("run_id", F.lit(run_id).cast("long")).withColumn("step", F.lit(step).cast("int"))
       .hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("run_id", "step").parquet(path))


def aligned(df: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt to the buckets of a table bucketed by ``(tensor, row)``: a partition a bucket."""
    return df.repartition(buckets, "tensor", "row")


def saved_steps(spark: SparkSession, path: str, run_id: int) -> list[int]:
    """The steps of a run that are in storage, in order."""
    return sorted(int(n.removeprefix("step=")) for n in listed(spark, f"{path}/run_id={int(run_id)}") if n.startswith("step="))


def expire_steps(spark: SparkSession, path: str, run_id: int, keep: int) -> list[int]:
    """Remove all but the last ``keep`` steps of a run; the steps removed."""
    old = saved_steps(spark, path, run_id)[:-keep] if keep else saved_steps(spark, path, run_id)
    for step in old:
        removed(spark, f"{path}/run_id={int(run_id)}/step={step}")
    return old


def read_tensors(spark: SparkSession, path: str, run_id: int | None = None, step: int | None = None,
                 tensor_prefix: str | None = None, buckets: int | None = None) -> DataFrame:
    """Load a checkpoint; run, step and name filters prune partitions and row groups.
    ``buckets`` (as written) reads it as the bucketed table."""
    df = spark.table(checkpoint_table(spark, path, buckets)) if buckets else spark.read.parquet(path)
    if run_id is not None:
        df = df.filter(F.col("run_id") == run_id)
    if step is not None:
        df = df.filter(F.col("step") == step)
    if tensor_prefix:
        df = df.filter(F.col("tensor").startswith(tensor_prefix))
    return df


def write_adapter(tensors: DataFrame, config: dict, path: str, adapter_id: str) -> None:
    """Persist only adapter tensors plus a one-row configuration, under ``adapter_id``."""
    spark = tensors.sparkSession
    (tensors.withColumn("adapter_id", F.lit(adapter_id)).hint("rebalance")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("adapter_id").parquet(path + "/tensors"))
    cfg = spark.createDataFrame([(adapter_id, json.dumps(config, sort_keys=True))], "adapter_id string, config string")
    (cfg.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("adapter_id").json(path + "/config"))


def read_adapter(spark: SparkSession, path: str, adapter_id: str) -> tuple[DataFrame, DataFrame]:
    """(tensors, config) for one adapter; config fields parsed into columns."""
    t = spark.read.parquet(path + "/tensors").filter(F.col("adapter_id") == adapter_id)
    c = spark.read.schema("config string, adapter_id string").json(path + "/config").filter(
        F.col("adapter_id") == adapter_id)
    cfg = c.select("adapter_id", F.from_json("config", ADAPTER_CONFIG_SCHEMA).alias("c")).select("adapter_id", "c.*")
    return t, cfg


ADAPTER_CONFIG_SCHEMA = ("peft_type string, r int, lora_alpha int, lora_dropout double, bias string, "
                         "fan_in_fan_out boolean, target_modules array<string>, modules_to_save array<string>, "
                         "rank_pattern map<string,int>, alpha_pattern map<string,int>, task_type string")


def write_tensor_table(df: DataFrame, path: str, buckets: int = 64, name: str | None = None) -> DataFrame:
    """Write a checkpoint as a table bucketed and sorted by ``(tensor, row)`` at a
    shared ``path`` and return it. Two checkpoints bucketed the same way join
    on ``(tensor, row)`` (J3, J4) without a shuffle."""
    import uuid
    name = name or f"tensors_{uuid.uuid4().hex[:12]}"
    (aligned(df, buckets).write.mode("overwrite").bucketBy(buckets, "tensor", "row").sortBy("tensor", "row")
       .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def open_tensor_table(spark: SparkSession, path: str, schema: str = TENSOR_SCHEMA, buckets: int = 64,
                      name: str | None = None) -> DataFrame:
    """Register a bucketed checkpoint written by ``write_tensor_table`` in this
    session, restoring its bucket layout, and return it."""
    import uuid
    name = name or f"tensors_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (tensor, row) "
              f"SORTED BY (tensor, row) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
