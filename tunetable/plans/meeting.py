"""Rows that meet the one model their key names: adapters, conditioning vectors.

Models and rows are dealt by (key, salt) and sorted so that a model comes
before its rows; a task holds one model and one Arrow batch at a time, however
many models and rows there are. Only keys with more rows than a task should
take get several salts, as many as their count asks for, so a rare model
travels once and a hot one as often as it must.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import materialize

ROWS_PER_TASK = 500_000


def heavy_keys(rows: DataFrame, key: str, rows_per_task: int, salts: int) -> DataFrame:
    """``(key, salts)`` of the keys with more than ``rows_per_task`` rows: one salt for each so many rows, ``salts`` at most.

    Counts are combined before the shuffle. Fewer than rows / ``rows_per_task``
    keys are heavy, so the table stays small beside the rows; it is stored, and
    Spark knows its size when it chooses a join.
    """
    n = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return materialize(n.filter(F.col("__n") > rows_per_task).select(key, F.least(F.ceil(F.col("__n") / rows_per_task), F.lit(salts)).cast("int").alias("__salts")))


def per_model(models: DataFrame, rows: DataFrame, key: str, load: Callable, fn: Callable, schema: str,
              rows_per_task: int = ROWS_PER_TASK, setup: Callable[[], object] | None = None, salts: int = 4096) -> DataFrame:
    """``fn(shared, model, batch)`` over all ``rows``, in batches of one key.

    ``models`` holds at most one row for a ``key`` (the rest of its columns go
    to ``load(shared, struct)``, once per task that meets the key); ``batch`` is
    an Arrow batch of the columns of ``rows``. Keys are compared as text. Rows
    whose key is null or names no model get ``model = None``. ``setup`` runs
    once per task.
    """
    models, rows = (df.withColumn("__k", F.col(key).cast("string")) for df in (models, rows))
    heavy = heavy_keys(rows.select("__k"), "__k", rows_per_task, salts)
    cols = [c for c in rows.columns if c != "__k"]
    own = F.struct(*(F.col(c) for c in models.columns if c not in (key, "__k")))
    copies = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    known = models.filter("__k IS NOT NULL").join(heavy, "__k", "left").select("__k", F.explode(copies).alias("__s"), F.lit(0).alias("__kind"), own.alias("__m"))
    each = rows.withColumn("__i", F.monotonically_increasing_id()).join(heavy, "__k", "left").select(
        "__k", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod("__i", "__salts")).cast("int").alias("__s"), F.lit(1).alias("__kind"), F.struct(*cols).alias("__r"))
    # a null key meets no model: its rows are dealt by their number
    each = each.withColumn("__s", F.when(F.col("__k").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 10)).cast("int")).otherwise(F.col("__s")))
    met = known.unionByName(each, allowMissingColumns=True).repartition("__k", "__s").sortWithinPartitions("__k", "__s", "__kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = setup() if setup else None
        now = model = None
        for b in batches:
            if not b.num_rows:
                continue
            kinds, keys = b.column("__kind").to_pylist(), b.column("__k").to_pylist()
            cuts = [0] + [i for i in range(1, len(keys)) if kinds[i] == 0 or kinds[i - 1] == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if kinds[lo] == 0:
                    now, model = keys[lo], load(shared, b.column("__m")[lo])
                    continue
                part = b.column("__r").slice(lo, hi - lo)
                part = pa.RecordBatch.from_arrays(part.flatten(), names=cols)
                yield fn(shared, model if now is not None and keys[lo] == now else None, part)

    return met.mapInArrow(run, schema)
