"""Tensor-table operators.

A checkpoint is a table with one row per matrix row:
``tensor, row, ndim, shape, dtype, values``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col_of


def last_component(name) -> Column:
    return F.element_at(F.split(col_of(name), "\\."), -1)


def target_modules(df: DataFrame, names: Sequence[str], name_col: str = "tensor") -> DataFrame:
    """Keep tensors whose module's last dotted component is in ``names``.

    Written as ``name = n OR name ends with '.n'`` (equal for dot-free names),
    which Parquet scans accept as pushed string predicates, instead of
    splitting every name.
    """
    c = col_of(name_col)
    cond = None
    for n in names:
        if "." in n:
            term = last_component(name_col) == n
        else:
            term = (c == n) | c.endswith("." + n)
        cond = term if cond is None else cond | term
    return df.filter(cond if cond is not None else F.lit(False))


def target_modules_regex(df: DataFrame, pattern: str, name_col: str = "tensor") -> DataFrame:
    """Keep tensors whose whole name matches ``pattern`` (full match, not search)."""
    return df.filter(col_of(name_col).rlike("^(?:" + pattern + ")$"))


def module_component(name, depth: int = 4) -> Column:
    """Dotted component at 0-based ``depth``, or '' when the name is shorter."""
    return F.coalesce(F.get(F.split(col_of(name), "\\."), F.lit(depth)), F.lit(""))


def distinct_components(df: DataFrame, depth: int = 4, name_col: str = "tensor",
                        kinds: Sequence[str] | None = ("Linear", "Embedding", "Conv2d", "Conv1D"),
                        kind_col: str = "kind") -> DataFrame:
    """Distinct module components of the layer kinds that can carry an adapter."""
    d = df
    if kinds is not None and kind_col in df.columns:
        d = d.filter(F.col(kind_col).isin(list(kinds)))
    return d.select(module_component(name_col, depth).alias("component")).distinct()


def mark_trainable(df: DataFrame, modules_to_save: Sequence[str] = (), adapter_marker: str = "lora_",
                   name_col: str = "tensor") -> DataFrame:
    """Base tensors frozen; adapter tensors and ``modules_to_save`` trainable; 1-D tensors stored float32."""
    name = col_of(name_col)
    comps = F.split(name, "\\.")
    is_adapter = F.exists(comps, lambda c: c.startswith(adapter_marker))
    saved = F.exists(comps, lambda c: c.isin(list(modules_to_save))) if modules_to_save else F.lit(False)
    return (df.withColumn("trainable", is_adapter | saved)
            .withColumn("dtype", F.when(F.col("ndim") == 1, F.lit("float32")).otherwise(F.col("dtype"))))


def trainable_summary(df: DataFrame) -> DataFrame:
    """Trainable numbers, all numbers and the trainable percentage (one row).

    Numbers are counted from ``shape`` (of the stored row), so the values are not read."""
    numel = F.aggregate("shape", F.lit(1).cast("long"), lambda n, x: n * x)
    return df.agg(F.sum(F.when(F.col("trainable"), numel).otherwise(0)).alias("trainable_params"),
                  F.sum(numel).alias("all_params")).select(
        "trainable_params", "all_params",
        (F.lit(100.0) * F.col("trainable_params") / F.col("all_params")).alias("trainable_pct"))


def changed_tensors(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Per tensor present in both: rows compared, rows changed, any change.

    NaN compares equal to NaN here (Spark's rule).
    """
    b = base.select("tensor", "row", F.col("values").alias("__bv"))
    t = tuned.select("tensor", "row", F.col("values").alias("__tv"))
    j = b.join(t, ["tensor", "row"])
    diff = F.col("__bv") != F.col("__tv")
    return j.groupBy("tensor").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.count_if(diff).alias("n_changed"),
                                   F.bool_or(diff).alias("changed"))


def reconcile(expected: DataFrame, given: DataFrame, keys=("tensor", "row"),
              shape_col: str = "shape") -> DataFrame:
    """Classify every key as matched / missing / unexpected / shape_mismatch (full outer join)."""
    keys = list(keys)
    e = expected.select(*keys, F.col(shape_col).alias("__es"), F.lit(True).alias("__e"))
    g = given.select(*keys, F.col(shape_col).alias("__gs"), F.lit(True).alias("__g"))
    j = e.join(g, keys, "full_outer")
    status = (F.when(F.col("__e").isNull(), F.lit("unexpected"))
              .when(F.col("__g").isNull(), F.lit("missing"))
              .when(~F.col("__es").eqNullSafe(F.col("__gs")), F.lit("shape_mismatch"))
              .otherwise(F.lit("matched")))
    return j.select(*keys, status.alias("status"))


def _counted(left: DataFrame, right: DataFrame, keys: list) -> DataFrame:
    """``(*keys, __l, __r)``: how often each key is on either side, nulls equal.

    Both sides are counted before they meet. Sides bucketed by ``keys`` are
    counted where they lie and merged bucket by bucket, without a shuffle; a
    key with very many rows is one row after its count. Only rows with a null
    key go another way, as null-safe keys don't fit the buckets.
    """
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))

    def met(rows, safe: bool) -> DataFrame:
        n = [df.filter(rows).groupBy(*keys).agg(F.count(F.lit(1)).alias(side)).select(*(F.col(k).alias(f"{side}{k}") for k in keys), side) for df, side in ((left, "__l"), (right, "__r"))]
        pairs = [(n[0][f"__l{k}"], n[1][f"__r{k}"]) for k in keys]
        on = reduce(lambda a, b: a & b, (x.eqNullSafe(y) if safe else x == y for x, y in pairs))
        return n[0].join(n[1], on, "full_outer").select(
            *(F.when(F.col("__l").isNotNull(), F.col(f"__l{k}")).otherwise(F.col(f"__r{k}")).alias(k) for k in keys),
            F.coalesce("__l", F.lit(0)).alias("__l"), F.coalesce("__r", F.lit(0)).alias("__r"))

    return met(~null, False).unionByName(met(null, True))


#: Copies of a key that one row of the plan makes.
_COPIES = 4096


def key_difference(left: DataFrame, right: DataFrame, keys=("tensor", "row")) -> DataFrame:
    """Keys of ``left`` absent from ``right`` (multiset difference, EXCEPT ALL): each as often as it is more often in ``left``."""
    more = _counted(left, right, list(keys)).withColumn("__m", F.col("__l") - F.col("__r")).filter("__m > 0")
    blocks = more.select(*keys, "__m", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("__m") - 1, F.lit(_COPIES)))).alias("__b"))
    left_over = F.least(F.lit(_COPIES), F.col("__m") - F.col("__b") * _COPIES)
    return blocks.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), left_over)).alias("__c")).select(*keys)


def key_intersection(left: DataFrame, right: DataFrame, keys=("tensor", "row")) -> DataFrame:
    """Keys present in both (INTERSECT, distinct)."""
    return _counted(left, right, list(keys)).filter("__l > 0 AND __r > 0").select(*keys)


class LoadError(ValueError):
    """A checkpoint that can't be loaded as asked; ``counts`` says how many keys have which status."""

    def __init__(self, message: str, counts: dict) -> None:
        super().__init__(f"{message}: {counts}")
        self.counts = counts


def load_checked(expected: DataFrame, given: DataFrame, strict: bool = True,
                 ignore_mismatched: bool = False, keys=("tensor", "row")) -> DataFrame:
    """Load ``given`` against ``expected``.

    Strict: any key not matched raises. Non-strict: matched keys only, the rest
    reported by ``reconcile``. A shape mismatch raises in both modes unless
    ``ignore_mismatched``. The check is one distributed aggregate.
    """
    rep = reconcile(expected, given, keys)
    counts = {r["status"]: r["n"] for r in rep.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts.get("shape_mismatch", 0) and not ignore_mismatched:
        raise LoadError(f"shape mismatch on {counts['shape_mismatch']} keys", counts)
    bad = counts.get("missing", 0) + counts.get("unexpected", 0)
    if strict and (bad or counts.get("shape_mismatch", 0)):
        raise LoadError("strict load failed", counts)
    ok = rep.filter(F.col("status") == "matched").select(*keys)
    return given.join(ok, list(keys), "left_semi")


def pair_weights(df: DataFrame, key_kind: str = "mlp.c_fc", value_kind: str = "mlp.c_proj",
                 name_col: str = "tensor") -> DataFrame:
    """Per layer, the ``key_kind`` and ``value_kind`` tensors side by side as
    ``past_key{i}`` / ``past_value{i}`` entries (pivot with fixed values)."""
    layer = F.regexp_extract(col_of(name_col), "\\.h\\.(\\d+)\\.", 1).cast("int")
    kind = F.regexp_extract(col_of(name_col), "\\.h\\.\\d+\\.(.+)$", 1)
    d = df.select(layer.alias("layer"), kind.alias("kind"), col_of(name_col).alias("tensor"))
    d = d.filter(F.col("kind").isin(key_kind, value_kind))
    p = d.groupBy("layer").pivot("kind", [key_kind, value_kind]).agg(
        F.min("tensor").alias("t"), F.count(F.lit(1)).alias("n"))
    cols = p.columns
    kt = [c for c in cols if c.startswith(key_kind) and c.endswith("_t")][0]
    kn = [c for c in cols if c.startswith(key_kind) and c.endswith("_n")][0]
    vt = [c for c in cols if c.startswith(value_kind) and c.endswith("_t")][0]
    vn = [c for c in cols if c.startswith(value_kind) and c.endswith("_n")][0]
    return p.select("layer",
                    F.concat(F.lit("past_key"), F.col("layer")).alias("key_name"),
                    F.col(f"`{kt}`").alias("key_tensor"), F.coalesce(F.col(f"`{kn}`"), F.lit(0)).alias("key_rows"),
                    F.concat(F.lit("past_value"), F.col("layer")).alias("value_name"),
                    F.col(f"`{vt}`").alias("value_tensor"), F.coalesce(F.col(f"`{vn}`"), F.lit(0)).alias("value_rows"))
