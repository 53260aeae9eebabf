"""Generation-candidate operators: settings (P10), candidates (J5), filters and
sampling (W6-W9), ranking (O1, O2, O4).

Score groups are (request, step) over a vocabulary: bounded by the vocabulary
size, so windows over them are bounded tasks. Per-request candidate ranking
(O1) plans as a map-side ``WindowGroupLimit`` so a hot request ships at most
k rows per map task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import col_of, keyed_hash
from ..plans.joins import constant_table

# Fixed values (must equal the reference's): default generation settings and presets.
DEFAULT_SETTINGS = {"temperature": "0.8", "length_penalty": "1.0", "repetition_penalty": "2.0",
                    "top_p": "0.8", "cond_free_k": "2.0", "diffusion_temperature": "1.0"}
PRESETS = {
    "ultra_fast": {"num_autoregressive_samples": "1", "diffusion_iterations": "30", "cond_free": "False"},
    "high_quality": {"num_autoregressive_samples": "1", "diffusion_iterations": "30"},
}


def presets_table(spark: SparkSession, presets: dict = PRESETS) -> DataFrame:
    rows = constant_table(spark, [(k, json.dumps(v)) for k, v in presets.items()], "preset string, settings string")
    return rows.select("preset", F.from_json("settings", "map<string,string>").alias("settings"))


def _map_lit(d: dict) -> Column:
    if not d:
        return F.create_map().cast("map<string,string>")
    args = []
    for k, v in d.items():
        args += [F.lit(k), F.lit(str(v))]
    return F.create_map(*args)


def resolve_settings(requests: DataFrame, presets: DataFrame, defaults: dict = DEFAULT_SETTINGS,
                     preset_col: str = "preset", overrides_col: str | None = "overrides") -> DataFrame:
    """Per key: defaults < preset < request override, into ``settings map<string,string>``.

    An unknown preset name fails the job. ``presets`` is a configuration table.
    """
    p = presets.select(F.col("preset").alias("__pname"), F.col("settings").alias("__pset"))
    j = requests.join(p, col_of(preset_col) == F.col("__pname"), "left")
    unknown = col_of(preset_col).isNotNull() & F.col("__pname").isNull()
    d = _map_lit(defaults)
    ps = F.coalesce(F.col("__pset"), F.create_map().cast("map<string,string>"))
    ov = (F.coalesce(col_of(overrides_col), F.create_map().cast("map<string,string>"))
          if overrides_col and overrides_col in requests.columns
          else F.create_map().cast("map<string,string>"))
    keys = F.array_distinct(F.concat(F.map_keys(d), F.map_keys(ps), F.map_keys(ov)))
    merged = F.map_from_entries(F.transform(keys, lambda k: F.struct(
        k.alias("key"),
        F.coalesce(F.try_element_at(ov, k), F.try_element_at(ps, k), F.try_element_at(d, k)).alias("value"))))
    settings = F.when(unknown, F.raise_error(F.concat(F.lit("unknown preset: "), col_of(preset_col)))
                      .cast("map<string,string>")).otherwise(merged)
    return j.withColumn("settings", settings).drop("__pname", "__pset")


def attach_candidates(df: DataFrame, n: int, out: str = "cand_id") -> DataFrame:
    """Repeat each request for its N candidates, ids 0..n-1 in consecutive order."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _groups(group):
    return [group] if isinstance(group, str) else list(group)


def softmax(df: DataFrame, group, score: str, temperature: float = 1.0, out: str = "prob",
            log_out: str | None = None) -> DataFrame:
    """Numerically stable softmax of ``score / temperature`` inside each group.

    ``log_out`` also keeps the log-probability, computed as a log-softmax
    (finite even where the probability underflows to 0). A score that is not
    a finite number counts as missing: its probability is null and it takes
    no part in the group's sum.
    """
    w = Window.partitionBy(*_groups(group))
    raw = col_of(score).cast("double")
    usable = ~F.isnan(raw) & (F.abs(raw) < F.lit(float("inf")))
    z = F.when(usable, raw) / F.lit(float(temperature))
    d = (df.withColumn("__z", z)
         .withColumn("__zs", F.col("__z") - F.max("__z").over(w))
         .withColumn("__e", F.exp("__zs"))
         .withColumn("__se", F.sum("__e").over(w))
         .withColumn(out, F.col("__e") / F.col("__se")))
    if log_out:
        d = d.withColumn(log_out, F.col("__zs") - F.log(F.col("__se")))
    return d.drop("__z", "__zs", "__e", "__se")


def nucleus_filter(df: DataFrame, group, score: str, token: str, p: float = 0.8,
                   temperature: float = 0.8) -> DataFrame:
    """Top-p: keep the smallest most-probable prefix whose mass reaches ``p``.

    The crossing token is kept, so a group with a finite score never empties;
    tokens without one are left out. Ties on probability go to the lower
    token id.
    """
    g = _groups(group)
    d = softmax(df, g, score, temperature)
    w = (Window.partitionBy(*g).orderBy(F.col("prob").desc(), col_of(token).asc())
         .rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("cum_prob", F.sum("prob").over(w))
    return d.filter(F.col("cum_prob") - F.col("prob") < F.lit(float(p)))


def typical_filter(df: DataFrame, group, score: str, token: str, mass: float = 0.9) -> DataFrame:
    """Locally typical filtering: order by |surprise - entropy|, keep until ``mass`` is reached."""
    g = _groups(group)
    d = softmax(df, g, score, 1.0, log_out="__lp")
    wg = Window.partitionBy(*g)
    d = d.withColumn("__h", -F.sum(F.col("prob") * F.col("__lp")).over(wg))
    d = d.withColumn("typical_dev", F.abs(-F.col("__lp") - F.col("__h")))
    w = (Window.partitionBy(*g).orderBy(F.col("typical_dev").asc(), col_of(token).asc())
         .rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("cum_prob", F.sum("prob").over(w))
    return d.filter(F.col("cum_prob") - F.col("prob") < F.lit(float(mass))).drop("__lp", "__h")


def seeded_uniform(seed: int, *cols) -> Column:
    """Uniform in (0, 1) as a pure function of the key columns and seed (retry-safe)."""
    top = F.shiftright(keyed_hash(seed, *cols), 8)
    return (top.cast("double") + 0.5) / float(1 << 52)


def sample_per_group(df: DataFrame, group, token: str, prob: str = "prob", n: int = 1,
                     seed: int = 0) -> DataFrame:
    """Draw ``n`` tokens per group from ``prob`` (Gumbel-max), deterministic under retries.

    Output: group columns, ``draw`` (0..n-1), the drawn token and its prob.
    """
    g = _groups(group)
    d = df.filter(col_of(prob) > 0).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = seeded_uniform(seed, *g, token, "draw")
    d = d.withColumn("__key", F.log(col_of(prob)) - F.log(-F.log(u)))
    w = Window.partitionBy(*g, "draw").orderBy(F.col("__key").desc(), col_of(token).asc())
    return d.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__key")


def repetition_penalty(scores: DataFrame, history: DataFrame, group, token: str, score: str,
                       penalty: float = 2.0) -> DataFrame:
    """Tokens already generated in the group: score < 0 -> score * penalty, else score / penalty."""
    g = _groups(group)
    h = history.select(*g, token).distinct().withColumn("__seen", F.lit(True))
    j = scores.join(h, g + [token], "left")
    s = col_of(score)
    new = (F.when(F.col("__seen").isNull(), s)
           .when(s < 0, s * penalty).otherwise(s / penalty))
    return j.withColumn(score, new).drop("__seen")


def top_k(df: DataFrame, group, score: str, id_col: str, k: int = 1, out: str = "rank") -> DataFrame:
    """Best ``k`` rows per group by score; ties to the lowest id."""
    w = Window.partitionBy(*_groups(group)).orderBy(col_of(score).desc(), col_of(id_col).asc())
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def first_candidate(df: DataFrame, group, id_col: str) -> DataFrame:
    """Row with the smallest id per group (partial aggregation, no window)."""
    g = _groups(group)
    rest = [c for c in df.columns if c not in g]
    agg = df.groupBy(*g).agg(F.min_by(F.struct(*rest), col_of(id_col)).alias("__first"))
    return agg.select(*g, *[F.col("__first")[c].alias(c) for c in rest])


def _dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def similarity_score(a, b) -> Column:
    """Cosine similarity of two vectors in double; null when either is a zero vector."""
    a, b = col_of(a), col_of(b)
    na = F.sqrt(_dot(a, a))
    nb = F.sqrt(_dot(b, b))
    return _dot(a, b) / F.nullif(na * nb, F.lit(0.0))
