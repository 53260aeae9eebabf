"""Manifest operators: length filter (P5), clip pairing (J1), conditioning candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import col_of, idiv
from ..plans.joins import constant_table
from ..plans.prefix import hash_bucket, int_bucket, row_index

# Fixed per-phase values (must equal the reference configuration):
# phase, max text tokens, max wav samples, batch size, conditioning clips.
PHASE_LIMITS = (
    ("train", 350, 551250, 64, 3),
    ("val", 200, 286715, 13, 2),
)


def phase_limits(spark: SparkSession, rows=PHASE_LIMITS) -> DataFrame:
    return constant_table(spark, rows, "phase string, max_text int, max_wav long, batch int, n_cond int")


def label_by_length(df: DataFrame, limits: DataFrame, text_len: str = "text_len",
                    wav_len: str = "wav_len", phase: str = "phase") -> DataFrame:
    """Every row with a ``reason``: null where text_len <= max_text and wav_len <= max_wav, else
    the first of: unknown phase, null length, text too long, wav too long.

    ``limits`` is a per-phase configuration table; the planner broadcasts it
    when its known size is small.
    """
    lim = limits.select(F.col("phase").alias("__lphase"), "max_text", "max_wav")
    j = df.join(lim, col_of(phase) == F.col("__lphase"), "left")
    reason = (F.when(F.col("__lphase").isNull(), F.lit("unknown_phase"))
              .when(col_of(text_len).isNull() | col_of(wav_len).isNull(), F.lit("null_length"))
              .when(col_of(text_len) > F.col("max_text"), F.lit("text_too_long"))
              .when(col_of(wav_len) > F.col("max_wav"), F.lit("wav_too_long")))
    return j.withColumn("reason", reason).drop("__lphase", "max_text", "max_wav")


def filter_by_length(df: DataFrame, limits: DataFrame, text_len: str = "text_len",
                     wav_len: str = "wav_len", phase: str = "phase") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) by ``label_by_length``; ``dropped`` carries the ``reason``. kept + dropped = input."""
    j = label_by_length(df, limits, text_len, wav_len, phase)
    return j.filter(F.col("reason").isNull()).drop("reason"), j.filter(F.col("reason").isNotNull())


def pair_clips(manifest: DataFrame, clips: DataFrame, key: str = "audio_path"
               ) -> tuple[DataFrame, DataFrame]:
    """(paired, missing): equi inner join on the clip path; unmatched utterances kept aside.

    Both sides grow with the data, so this is a shuffle join; AQE splits a
    skewed path key.
    """
    paired = manifest.join(clips, on=key, how="inner")
    missing = manifest.join(clips.select(key), on=key, how="left_anti")
    return paired, missing


def conditioning_candidates(df: DataFrame, group, id_col: str, k, width: int = 1024,
                            out: str = "cond_id", max_k: int | None = None, chunk: int = 1024,
                            seed: int | None = None) -> DataFrame:
    """K *other* members of the same group per row, no self-join.

    Members are numbered 0..cnt-1 by ``id_col`` inside the group (two-level
    index, so a hot group is never one task); row r takes members
    ``(r + j) mod cnt`` for j = 1..min(k, cnt - 1): the next K cyclically, no
    repeats, fewer when the group is small.

    The numbering is cut into chunks of ``chunk`` members. Each chunk's window
    also holds a halo: the first ``max_k`` members of the next chunk, and, for
    the last two chunks, the group's first ``max_k`` members numbered after
    the end (the cyclic wrap). ``lead(id, j)`` inside a chunk then gives the
    j-th next member. Every window holds at most ``chunk + 2 * max_k`` rows,
    and the plan is lazy (no self-join, no materialisation).

    ``k`` may be a column (per-row count, at most ``max_k``). With ``seed``,
    members are numbered in seeded-hash order (``xxhash64(seed, id)``, ties by
    id): a reproducible shuffle of who conditions whom; without it, in id
    order. Output: group columns, ``id_col``, ``cond_rank`` (1..k) and ``out``.
    """
    group = [group] if isinstance(group, str) else list(group)
    kmax = max_k if max_k is not None else (k if isinstance(k, int) else None)
    if kmax is None:
        raise ValueError("max_k is required when k is a column")
    if kmax > chunk:
        raise ValueError("chunk must be at least max_k")
    kcol = F.lit(k) if isinstance(k, int) else k
    narrow = df.select(*group, id_col, kcol.cast("int").alias("__k"))
    if seed is None:
        d = row_index(narrow, [id_col], int_bucket(id_col, width), group, out="__rn", total="__cnt")
    else:
        narrow = narrow.withColumn("__h", F.xxhash64(F.lit(seed), F.col(id_col)))
        d = row_index(narrow, ["__h", id_col], hash_bucket("__h", 16), group, out="__rn", total="__cnt").drop("__h")
    c = idiv(F.col("__rn"), F.lit(chunk))
    last = idiv(F.col("__cnt") - 1, F.lit(chunk))
    copy = lambda home, pos, native, valid: F.struct(
        home.alias("home"), pos.alias("pos"), F.lit(native).alias("native"), valid.alias("valid"))
    head = F.col("__rn") < kmax
    copies = F.array(
        copy(c, F.col("__rn"), True, F.lit(True)),
        copy(c - 1, F.col("__rn"), False, (c >= 1) & (F.pmod(F.col("__rn"), F.lit(chunk)) < kmax)),
        copy(last, F.col("__rn") + F.col("__cnt"), False, head),
        copy(last - 1, F.col("__rn") + F.col("__cnt"), False, head & (last >= 1)))
    d = d.select(*group, id_col, "__k", "__cnt",
                 F.explode(F.filter(copies, lambda x: x["valid"])).alias("__c")).select(
        *group, id_col, "__k", "__cnt", F.col("__c.home").alias("__home"), F.col("__c.pos").alias("__pos"),
        F.col("__c.native").alias("__native"))
    # shuffle by (group, chunk) explicitly, so that no partitioning by the group
    # alone can satisfy this window and keep a hot group in one task
    d = d.repartition(*group, "__home")
    w = Window.partitionBy(*group, "__home").orderBy("__pos")
    nexts = F.array(*[F.lead(id_col, j).over(w) for j in range(1, kmax + 1)])
    d = d.withColumn("__next", nexts).filter("__native")
    take = F.least(F.col("__k"), F.col("__cnt") - 1)
    return (d.select(*group, id_col, take.alias("__take"), F.posexplode("__next").alias("__j", out))
            .filter(F.col("__j") < F.col("__take"))
            .select(*group, id_col, (F.col("__j") + 1).cast("int").alias("cond_rank"), out))
