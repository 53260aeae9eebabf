"""Metrics: latency summary (A2), weighted loss (A3), rolling loss (W3), cadence."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import col_of, idiv
from ..functions.lengths import cadence_flag
from ..plans.prefix import int_bucket, row_index

# Fixed values (must equal the reference configuration): loss weights.
LOSS_WEIGHTS = {"loss_text_ce": 0.01, "loss_mel_ce": 1.0}
# Cadence: checkpoint, validation and visuals every 100 steps, log every 500.
CADENCE = {"save_checkpoint": 100, "validate": 100, "visuals": 100, "log": 500}


def latency_summary(df: DataFrame, group, order, seconds: str = "seconds", warmup: int = 2) -> DataFrame:
    """Per group: drop the first ``warmup`` requests in ``order``, then count, total and mean seconds.

    The last warm-up row comes from a per-group top-``warmup`` (a map-side
    ``WindowGroupLimit``: at most ``warmup`` rows per group leave each map
    task). Rows after it are summed themselves, never a total minus the
    warm-up, so large or infinite warm-up values leave no trace. Rows with
    equal order are taken by their seconds; of rows equal in both, as many as
    belong to the warm-up are left out. No window ever holds a whole group.
    """
    g = [group] if isinstance(group, str) else list(group)
    order = [order] if isinstance(order, str) else list(order)
    keyed = df.select(*g, F.struct(*(col_of(o).alias(f"o{i}") for i, o in enumerate(order)), col_of(seconds).alias("s")).alias("__k"))
    w = Window.partitionBy(*g).orderBy("__k")
    warm = keyed.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= warmup)
    warm = warm.groupBy(*g).agg(F.max("__k").alias("__last"), F.collect_list("__k").alias("__warm"))  # at most ``warmup`` values
    warm = warm.withColumn("__at_last", F.size(F.filter("__warm", lambda k: k.eqNullSafe(F.col("__last"))))).drop("__warm")
    warm = warm.withColumnsRenamed({c: f"__g_{c}" for c in g})
    j = keyed.join(warm, reduce(and_, (keyed[c].eqNullSafe(warm[f"__g_{c}"]) for c in g)), "left")
    after = F.coalesce(F.col("__k") > F.col("__last"), F.lit(True))
    equal = F.coalesce(F.col("__k").eqNullSafe(F.col("__last")), F.lit(False))
    sec = F.col("__k.s")
    a = j.groupBy(*g).agg(
        F.count(F.when(after, 1)).alias("__n"), F.count(F.when(after, sec)).alias("__v"), F.sum(F.when(after, sec)).alias("__s"),
        (F.count(F.when(equal, 1)) - F.coalesce(F.max("__at_last"), F.lit(0))).alias("__left"), F.max(F.when(equal, sec)).alias("__tie"))
    kind = a.schema["__s"].dataType
    left = F.when(F.col("__tie").isNull(), F.lit(0)).otherwise(F.col("__left"))
    recorded = F.col("__v") + left
    tie = F.when(left > 0, F.col("__tie") * left).otherwise(F.lit(0)).cast(kind)
    tot = (F.coalesce("__s", F.lit(0).cast(kind)) + tie).cast(kind)
    # requests counted whether or not they recorded seconds; the mean is over recorded seconds
    return a.select(*g, (F.col("__n") + F.col("__left")).alias("n_requests"),
                    F.when(recorded > 0, tot).alias("total_seconds"),
                    F.when(recorded > 0, tot.cast("double") / recorded).alias("mean_seconds"))


def flag_warmup(df: DataFrame, group, order, warmup: int = 2, out: str = "is_warmup") -> DataFrame:
    """Mark the first ``warmup`` rows per group (top-k per group, joined back)."""
    g = [group] if isinstance(group, str) else list(group)
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*g).orderBy(*order)
    keys = g + [o for o in order if isinstance(o, str)]
    warm = (df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= warmup)
            .select(*keys).withColumn(out, F.lit(True)))
    return df.join(warm, keys, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def weighted_loss(df: DataFrame, weights: dict = LOSS_WEIGHTS, out: str = "loss_total") -> DataFrame:
    """Total loss = sum over named loss columns of weight * value."""
    expr = None
    for name, w in weights.items():
        term = F.lit(float(w)) * col_of(name)
        expr = term if expr is None else expr + term
    return df.withColumn(out, expr)


def cadence_flags(df: DataFrame, step: str = "step", cadence: dict = CADENCE) -> DataFrame:
    out = df
    for name, every in cadence.items():
        out = out.withColumn(f"is_{name}", cadence_flag(step, every))
    return out


def rolling_mean(df: DataFrame, group, order: str, value: str, n: int = 500,
                 out: str = "rolling_mean", width: int = 4096, dense: bool = False) -> DataFrame:
    """Mean of ``value`` over the last ``n`` rows per group (current row included).

    Also returns ``<out>_sum`` and ``<out>_count``; the mean is one division of
    the two (exact sums for decimal input).

    Exact without a whole-group window: rows are cut into chunks of ``n``
    consecutive positions, and every row is emitted twice by one ``explode``
    (into its own chunk and, as halo, into the next one). Each window then
    holds at most 2n rows, however large the group, and the input is read
    once. Positions come from the two-level index, or directly from ``order``
    when ``dense`` says it already counts rows (consecutive integers per group).
    """
    g = [group] if isinstance(group, str) else list(group)
    if dense:
        d = df.withColumn("__i", F.col(order).cast("long"))
    else:
        d = row_index(df, [order], int_bucket(order, width), g, out="__i")
    chunk = idiv(F.col("__i"), F.lit(n))
    d = d.withColumn("__home", F.explode(F.array(chunk, chunk + 1))).repartition(*g, "__home")
    # Inside one (group, home) partition the rows are the previous chunk and the
    # home chunk, in position order. For exact types the window sum is a running
    # sum minus the running sum n rows earlier (lag), O(1) per row; floating-point
    # input would lose small values next to large ones that way, so its frame of
    # n rows is summed itself.
    run = Window.partitionBy(*g, "__home").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy(*g, "__home").orderBy("__i")
    d = (d.withColumn("__s", F.sum(col_of(value)).over(run))
         .withColumn("__c", F.count(col_of(value)).over(run)))
    zero = F.lit(0).cast(d.schema["__s"].dataType)
    if isinstance(d.select(col_of(value)).schema[0].dataType, (T.DoubleType, T.FloatType)):
        total = F.sum(col_of(value)).over(order.rowsBetween(-(n - 1), 0))
    else:
        total = F.col("__s") - F.coalesce(F.lag("__s", n).over(order), zero)
    res = (d.withColumn(out + "_sum", total)
           .withColumn(out + "_count", F.col("__c") - F.coalesce(F.lag("__c", n).over(order), F.lit(0)))
           .withColumn(out, F.when(F.col(out + "_count") > 0, F.col(out + "_sum").cast("double") / F.col(out + "_count")))
           .filter(F.col("__home") == idiv(F.col("__i"), F.lit(n))))
    return res.drop("__i", "__home", "__s", "__c")
