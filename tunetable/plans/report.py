"""The flagship question, end to end.

"After cleaning, tokenising and length filtering, how many examples, tokens,
batches and optimiser steps does each phase give?"

manifest -> rewrite prefix -> normalise text -> BPE -> pair with clips ->
length filter -> aggregate by phase. The only Python is the
tokenising UDF; it runs once per line, before any shuffle, and its narrow
output is checkpointed so that no later branch repeats it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import standins as S
from ..functions import idiv
from ..functions.bpe import bpe_encode, load_tokenizer
from ..functions.text import normalise_text, rewrite_prefix
from ..operators.manifest import label_by_length, phase_limits
from ..plans.joins import spread
from ..plans.lineage import materialize
from ..resources import default_tokenizer_path
from ..sources.manifest import parse_manifest


def phase_report(spark: SparkSession, sf: str, tokenizer: str | None = None, accumulate: int = 4) -> DataFrame:
    tok = load_tokenizer(tokenizer or default_tokenizer_path())
    parsed, _rejects = parse_manifest(S.manifest_lines(spark, sf), keep=("line_no", "phase"))
    m = spread(parsed).select(
        "line_no", "phase", rewrite_prefix("audio_path", S.OLD_ROOT, S.NEW_ROOT).alias("audio_path"),
        F.size(bpe_encode(normalise_text("text"), tok)).alias("text_len"))
    # Tokenise before any shuffle, so no text crosses the network, and only once:
    # the narrow result is read once more only if a later stage has to run again.
    m = materialize(m)
    # one join gives every line its state, one aggregate counts the states of a phase
    j = m.join(S.clips(spark, sf).select("audio_path", "n_samples", F.lit(True).alias("found")), "audio_path", "left")
    limits = phase_limits(spark)
    state = label_by_length(j.withColumn("wav_len", F.col("n_samples")), limits)
    state = state.withColumn("state", F.when(F.col("found").isNull(), F.lit("missing"))
                             .otherwise(F.when(F.col("reason").isNull(), F.lit("kept")).otherwise(F.lit("dropped"))))
    of = lambda s, v: F.sum(F.when(F.col("state") == s, v))
    counts = state.groupBy("phase").agg(
        F.count_if(F.col("state") == "kept").alias("n_examples"), of("kept", F.col("text_len")).alias("n_tokens"),
        of("kept", F.col("wav_len")).alias("n_samples"), F.count_if(F.col("state") == "dropped").alias("n_dropped"),
        F.count_if(F.col("state") == "missing").alias("n_missing"))
    # every manifest line is accounted for: kept + dropped + missing clip + rejected
    rej = _rejects.groupBy("phase").agg(F.count(F.lit(1)).alias("n_rejected"))
    out = counts.join(rej, "phase", "full_outer").join(limits.select("phase", "batch"), "phase", "left")
    out = out.withColumn("n_batches", idiv(F.col("n_examples") + F.col("batch") - 1, F.col("batch")))
    eff = F.col("batch") * accumulate
    return out.select(
        "phase", F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"),
        F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
        F.coalesce("n_samples", F.lit(0)).cast("long").alias("n_samples"),
        F.coalesce("n_batches", F.lit(0)).cast("long").alias("n_batches"),
        F.coalesce(idiv(F.col("n_examples") + eff - 1, eff), F.lit(0)).cast("long").alias("n_steps"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"),
        F.coalesce("n_rejected", F.lit(0)).cast("long").alias("n_rejected"))
