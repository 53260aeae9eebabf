"""Exact running sums and row indexes without a single-task window.

A window with no (or a skewed) ``partitionBy`` sends a whole group to one
task. The two-level scheme keeps every window bounded:

1. the caller supplies a *bucket* column that is monotone non-decreasing in
   the order key inside each partition (``key div width``, high bits of a hash,
   a time slice);
2. a window runs inside each (partition, bucket) cell only;
3. the per-cell totals (one row per cell, partially aggregated map-side) are
   prefix-summed in a small table whose size is the number of cells;
4. the offsets are joined back on (partition, bucket) and added.

``ranged_sum`` and ``ranged_index`` need no bucket column: their cells are the
ranges of a range shuffle, which samples the order keys, so sparse, dense,
hashed or textual keys all give as many cells as partitions. The cells' totals
are summed level by level, ``FAN`` cells to one of the next level, so no window
and no task meets the whole table of cells either.

The input is read by two branches (the cell window and the cell totals).
The totals branch needs only the key, order and value columns, so a plain
scan costs little; an input produced by expensive per-row work (a
tokenising UDF) should be materialised first (``plans.lineage.materialize``),
as the flagship does. The partition keys are materialised as non-null
columns, so the cell window's exchange also serves the join back: the big
side is shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import materialize

_B = "__tt_bucket"
_L = "__tt_local"
_O = "__tt_offset"


def _cols(xs) -> list:
    if xs is None:
        return []
    if isinstance(xs, (str, Column)):
        return [xs]
    return list(xs)


def int_bucket(col: str | Column, width: int) -> Column:
    """Monotone bucket for an integer order key (truncating ``div`` is monotone)."""
    return F.call_function("div", col_of(col).cast("long"), F.lit(width).cast("long"))


def hash_bucket(hash_col: str | Column, bits: int = 12) -> Column:
    """Monotone bucket for a signed 64-bit hash order key: its top ``bits`` bits."""
    c = col_of(hash_col)
    return F.shiftright(c, 64 - bits)


def time_bucket(ts: str | Column, seconds: int = 3600) -> Column:
    """Monotone bucket for a timestamp order key: whole slices of ``seconds``."""
    micros = F.unix_micros(col_of(ts).cast("timestamp"))
    return F.call_function("div", micros, F.lit(seconds * 1_000_000).cast("long"))


def col_of(c):
    return F.col(c) if isinstance(c, str) else c


def _key_default(dt):
    from pyspark.sql import types as T
    if isinstance(dt, T.StringType):
        return F.lit("")
    if isinstance(dt, T.BooleanType):
        return F.lit(False)
    if isinstance(dt, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(0).cast(dt)
    return None


def running_sum(df: DataFrame, value: str | Column, order: Sequence, bucket: Column,
                partition: Sequence | None = None, out: str = "running_sum",
                inclusive: bool = True, total: str | None = None) -> DataFrame:
    """Add ``out`` = running sum of ``value`` in ``order`` within ``partition``.

    Exact and deterministic; equal to
    ``sum(value) over (partition by .. order by .. rows unbounded preceding)``
    (minus the current row when ``inclusive`` is false), provided ``order``
    is a total order inside each partition. ``total`` names a column for the
    partition's whole sum; it comes with the cell offsets, so no join on the
    partition keys alone is needed for it.

    The partition keys are materialised once as non-null key columns (value
    or a typed default, plus a null flag), and the cell window, the cell
    totals and the join back all use exactly those columns. The big side is
    therefore shuffled once (into cells); only the small offsets table moves
    again for the join.
    """
    part = _cols(partition)
    order = _cols(order)
    v = col_of(value)
    # a null order key sorts first, so its rows form the first bucket
    d = df.withColumn(_B, F.coalesce(bucket.cast("long"), F.lit(-(1 << 63)))).withColumn("__tt_v", v)
    keys = []
    for i, p in enumerate(part):
        name = p if isinstance(p, str) else None
        dt = df.schema[name].dataType if name in df.columns else None
        c = col_of(p)
        default = _key_default(dt) if dt is not None else None
        if default is None:  # other types: compare through their string form
            c, default = c.cast("string"), F.lit("")
        d = d.withColumn(f"__tt_p{i}", F.coalesce(c, default)).withColumn(f"__tt_n{i}", c.isNull())
        keys += [f"__tt_p{i}", f"__tt_n{i}"]
    cell = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Cells are the unit of work: shuffle by (keys, bucket) explicitly, so an input
    # already hash-partitioned by the keys alone (which would satisfy the window)
    # cannot leave a hot group in one task.
    d = d.repartition(*keys, _B).withColumn(_L, F.sum("__tt_v").over(cell))
    totals = d.groupBy(*keys, _B).agg(F.sum("__tt_v").alias("__tt_tot"))
    ow = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("__tt_tot").over(Window.partitionBy(*keys)).alias(total)] if total else []
    offsets = totals.select(*keys, _B, F.coalesce(F.sum("__tt_tot").over(ow), F.lit(0)).alias(_O), *whole)
    j = d.join(offsets, keys + [_B], "inner")
    res = F.col(_O) + F.col(_L)
    if not inclusive:
        res = res - F.col("__tt_v")
    return j.withColumn(out, res).drop(_B, _L, _O, "__tt_v", *keys)


def row_index(df: DataFrame, order: Sequence, bucket: Column,
              partition: Sequence | None = None, out: str = "idx", total: str | None = None) -> DataFrame:
    """0-based position of each row in ``order`` within ``partition`` (exact, scalable);
    ``total`` names a column for the partition's row count."""
    return running_sum(df, F.lit(1).cast("long"), order, bucket, partition, out=out,
                       inclusive=False, total=total)


#: Cells that make one of the next level.
FAN = 1024


def _dealt(df: DataFrame, order: Sequence, part: list) -> DataFrame:
    """``df`` by range of (part, order), sorted, with ``__cell`` (the range) and ``__at`` (its rows in order)."""
    keys = [*part, *order]
    d = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    return d.withColumn("__cell", F.shiftright("__at", 33))


def level_offsets(totals: DataFrame, part: list, value: str = "__tot", cell: str = "__cell") -> DataFrame:
    """``totals(*part, cell, value)`` with ``__off``, the sum of ``value`` over the earlier cells of its ``part``.

    Three levels: a window holds at most ``FAN`` rows of the first two and, as a
    cell is a partition number below 2^31, 2,048 of the third. Null ``part``
    values are a part of their own.
    """
    levels = [totals.select(*part, F.col(cell).alias("__c0"), F.col(value).alias("__v0"))]
    for k in (1, 2):
        up = levels[-1].withColumn(f"__c{k}", F.call_function("div", f"__c{k - 1}", F.lit(FAN)))
        levels.append(up.groupBy(*part, f"__c{k}").agg(F.sum(f"__v{k - 1}").alias(f"__v{k}")))
    top = Window.partitionBy(*part).orderBy("__c2").rowsBetween(Window.unboundedPreceding, -1)
    before = levels[2].withColumn("__off", F.coalesce(F.sum("__v2").over(top), F.lit(0))).drop("__v2")
    for k in (1, 0):
        inner = Window.partitionBy(*part, f"__c{k + 1}").orderBy(f"__c{k}").rowsBetween(Window.unboundedPreceding, -1)
        now = levels[k].withColumn(f"__c{k + 1}", F.call_function("div", f"__c{k}", F.lit(FAN)))
        now = now.withColumn("__in", F.coalesce(F.sum(f"__v{k}").over(inner), F.lit(0)))
        before = _null_safe(now, before, [*part, f"__c{k + 1}"]).select(*part, f"__c{k}", (F.col("__off") + F.col("__in")).alias("__off"))
    return before.withColumnRenamed("__c0", cell)


def _null_safe(left: DataFrame, right: DataFrame, keys: list) -> DataFrame:
    """An inner join on ``keys`` in which null equals null; the keys stay once."""
    right = right.select(*(F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = [left[k].eqNullSafe(right[f"__r_{k}"]) for k in keys]
    both = on[0]
    for x in on[1:]:
        both = both & x
    return left.join(right, both).drop(*(f"__r_{k}" for k in keys))


def ranged_index(df: DataFrame, order: Sequence, partition: Sequence | None = None, out: str = "idx") -> DataFrame:
    """0-based position of each row in ``order`` within ``partition``.

    Rows move once, by range; a row's place in its range is the difference of
    two row numbers, so nothing is summed row by row.
    """
    part, order = _cols(partition), _cols(order)
    d = materialize(_dealt(df, order, part))  # a range shuffle samples: its cells must not be dealt twice
    cells = d.groupBy(*part, "__cell").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__tot"))
    starts = level_offsets(cells, part)
    starts = _null_safe(starts, cells, [*part, "__cell"]).select(*part, "__cell", (F.col("__off") - F.col("__first")).alias("__shift"))
    return _null_safe(d, starts, [*part, "__cell"]).select(*df.columns, (F.col("__at") + F.col("__shift")).alias(out))


def ranged_sum(df: DataFrame, value: str, order: Sequence, partition: Sequence | None = None, out: str = "running_sum", inclusive: bool = True) -> DataFrame:
    """``sum(value) over (partition by .. order by .. rows unbounded preceding)`` of a long column, minus the row's own
    value unless ``inclusive``; null values count as 0.

    The sums inside a range are running sums of Arrow batches, one pass over the
    sorted range; ``df`` should be narrow (keys and the value).
    """
    part, order = _cols(partition), _cols(order)
    d = _dealt(df.withColumn("__v", F.coalesce(F.col(value).cast("long"), F.lit(0))), order, part)
    d = d.withColumn("__run", F.to_json(F.struct(*part), {"ignoreNullFields": "false"}) if part else F.lit("")).withColumn("__sum", F.lit(0).cast("long"))
    names = d.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("__v").to_numpy()
            keys = b.column("__run").dictionary_encode().indices.to_numpy()
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            total = np.cumsum(v)
            base = np.repeat(np.r_[0, total[new[1:] - 1]], np.diff(np.r_[new, len(v)]))
            first = b.column("__run")[0].as_py()
            sums = total - base
            if first == last:
                sums[:new[1] if len(new) > 1 else len(v)] += carry
            last, carry = b.column("__run")[len(v) - 1].as_py(), int(sums[-1])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sums)], names=names)

    d = materialize(d.mapInArrow(run, d.schema))
    starts = level_offsets(d.groupBy(*part, "__cell").agg(F.sum("__v").alias("__tot")), part).withColumnRenamed("__off", "__before")
    own = F.lit(0) if inclusive else F.col("__v")
    return _null_safe(d, starts, [*part, "__cell"]).select(*df.columns, (F.col("__before") + F.col("__sum") - own).alias(out))
