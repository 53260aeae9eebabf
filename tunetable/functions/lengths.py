"""Length, schedule and parameter arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import col_of, idiv, val_of

# Fixed values (must equal the reference's): sample rates 22,050 Hz in and
# 24,000 Hz out, 4 output samples per input step, 1,024 samples per code.
IN_RATE = 22050
OUT_RATE = 24000
UPSAMPLE = 4
CODE_COMPRESSION = 1024


def output_length(n) -> Column:
    """``n * 4 * 24000 div 22050``: product first, then floor (bigint)."""
    return idiv(col_of(n).cast("long") * UPSAMPLE * OUT_RATE, F.lit(IN_RATE).cast("long"))


def code_length(wav_len) -> Column:
    """Codes covering ``wav_len`` samples; the expected stop sits one past it."""
    return idiv(col_of(wav_len).cast("long"), F.lit(CODE_COMPRESSION).cast("long"))


def multistep_lr(step, base: float = 1e-5, milestones: Sequence[int] = (1000, 2000, 4000),
                 gamma: float = 0.5, warmup: int = -1) -> Column:
    """``base * gamma ** (#milestones <= step)``; linear warm-up over ``warmup`` steps when > 0."""
    s = col_of(step)
    ms = F.array(*[F.lit(int(m)) for m in milestones]) if milestones else F.array().cast("array<int>")
    k = F.size(F.filter(ms, lambda m: m <= s))
    lr = F.lit(float(base)) * F.pow(F.lit(float(gamma)), k)
    if warmup and warmup > 0:
        lr = F.when(s < warmup, lr * (s + 1) / F.lit(float(warmup))).otherwise(lr)
    return lr


def adapter_scale(alpha, r) -> Column:
    """Low-rank update scale alpha / r."""
    return val_of(alpha).cast("double") / val_of(r).cast("double")


def adapter_params(in_dim, out_dim, r) -> Column:
    """Trainable numbers of one adapted matrix: r * (in + out)."""
    return val_of(r).cast("long") * (val_of(in_dim).cast("long") + val_of(out_dim).cast("long"))


def cadence_flag(step, every: int) -> Column:
    return (col_of(step) % F.lit(every)) == 0
