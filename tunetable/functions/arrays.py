"""Array functions on token and code sequences.

All but ``position_ids`` are single Catalyst expressions (higher-order
functions over the array column), so they stay inside the JVM and work on
streaming DataFrames unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import col_of, idiv, keyed_hash, let, lit_of

# Fixed values of the code space (must equal the reference's for right results):
# content codes 0..8191, start code 8192, stop code 8193, calm code 83,
# and the three codes written at the end of a repaired sequence: 45, 45, 248.
START_CODE = 8192
STOP_CODE = 8193
CALM_CODE = 83
REPAIR_TAIL = (45, 45, 248)
# Text side: start token 255, stop token 0.
TEXT_START = 255
TEXT_STOP = 0


def pad_or_truncate(arr, n, fill=0) -> Column:
    """Right-pad with ``fill`` or cut, so the result has exactly ``n`` elements."""
    a = col_of(arr)
    n = lit_of(n)
    return F.slice(F.concat(a, F.array_repeat(lit_of(fill), n)), F.lit(1), n)


def pad_right(arr, k, fill) -> Column:
    """Append ``k`` fills; a negative ``k`` removes ``-k`` elements from the right."""
    a = col_of(arr)
    k = lit_of(k)
    return (F.when(k >= 0, F.concat(a, F.array_repeat(lit_of(fill), k)))
            .otherwise(F.slice(a, F.lit(1), F.greatest(F.size(a) + k, F.lit(0)))))


def append_stop(arr, stop) -> Column:
    return F.concat(col_of(arr), F.array(lit_of(stop)))


def align_inputs_targets(arr, start, stop) -> tuple[Column, Column]:
    """(inputs, targets) = ([start] + x, x + [stop]) for teacher forcing."""
    a = col_of(arr)
    return F.concat(F.array(lit_of(start)), a), F.concat(a, F.array(lit_of(stop)))


def mask_past_end(codes, wav_len, compression: int = 1024, stop: int = STOP_CODE) -> Column:
    """Positions at or after ``wav_len div compression + 1`` become ``stop``."""
    end = idiv(col_of(wav_len), F.lit(compression)) + 1
    return let({"a": col_of(codes), "end": end},
               lambda e: F.transform(e["a"], lambda x, i: F.when(i >= e["end"], F.lit(stop)).otherwise(x)))


def first_stop(codes, stop: int = STOP_CODE) -> Column:
    """0-based index of the first ``stop``; null when absent."""
    return F.nullif(F.array_position(col_of(codes), lit_of(stop)), F.lit(0)) - 1


def fix_codes(codes, stop: int = STOP_CODE, calm: int = CALM_CODE,
              tail: tuple = REPAIR_TAIL) -> Column:
    """Repair a generated code sequence.

    No stop: unchanged. Otherwise everything from the first stop on becomes
    ``calm`` and the last ``len(tail)`` positions become ``tail`` (always
    written, even over content when the stop is among them). A sequence with a
    stop but shorter than the tail cannot be repaired and gives null.
    """
    t = len(tail)

    def body(e):
        a, s, n = e["a"], e["s"], e["n"]

        def repl(x, i):
            r = F.when(i >= s, F.lit(calm)).otherwise(x)
            for j in range(t - 1, -1, -1):
                r = F.when(i == n - (t - j), F.lit(tail[j])).otherwise(r)
            return r

        return (F.when(s.isNull(), a)
                .when(n < t, F.lit(None))
                .otherwise(F.transform(a, repl)))

    # the array (once), then its stop position and length (once per row, not per element)
    return let({"a": col_of(codes)}, lambda e0: let(
        {"a": e0["a"], "s": first_stop(e0["a"], stop), "n": F.size(e0["a"])}, body))


def calm_cut(codes, calm: int = CALM_CODE, run: int = 8) -> Column:
    """Index k of the first calm code that makes the calm run longer than ``run``; -1 if none."""
    init = F.struct(F.lit(0).alias("i"), F.lit(0).alias("r"), F.lit(-1).alias("k"))

    def step(acc, x):
        r = F.when(x == calm, acc["r"] + 1).otherwise(F.lit(0))
        k = F.when((acc["k"] < 0) & (x == calm) & (acc["r"] + 1 > run), acc["i"]).otherwise(acc["k"])
        return F.struct((acc["i"] + 1).alias("i"), r.alias("r"), k.alias("k"))

    return F.aggregate(col_of(codes), init, step)["k"]


def trim_calm_run(codes, calm: int = CALM_CODE, run: int = 8) -> Column:
    """Cut the sequence where a run of ``calm`` codes first exceeds ``run``: ``run`` calm codes remain."""
    def body(e):
        return F.when(e["k"] < 0, e["a"]).otherwise(F.slice(e["a"], F.lit(1), e["k"]))

    return let({"a": col_of(codes)}, lambda e0: let({"a": e0["a"], "k": calm_cut(e0["a"], calm, run)}, body))


def crop_or_pad(arr, n, start=0) -> Column:
    """Shorter than ``n``: zero-pad right. Longer: take ``n`` from 0-based ``start``."""
    n = lit_of(n)
    return let({"a": col_of(arr)}, lambda e: F.when(F.size(e["a"]) <= n, pad_or_truncate(e["a"], n, 0)).otherwise(
        F.slice(e["a"], lit_of(start) + 1, n)))


def seeded_crop_start(arr, n, key, seed: int) -> Column:
    """Deterministic 'random' start in [0, size-n]: a pure function of key and seed."""
    gap = F.greatest(F.size(col_of(arr)) - lit_of(n), F.lit(0))
    return F.pmod(keyed_hash(seed, key), gap.cast("long") + 1).cast("int")


def array_join_safe(arr, sep: str = ",") -> Column:
    """Array as ``sep``-joined text for sinks and comparisons that take no arrays
    (a null array gives null; null elements are skipped)."""
    return F.array_join(col_of(arr), sep)


def for_each(arr, fn) -> Column:
    """Apply one element transform to every element of an array column."""
    return F.transform(col_of(arr), fn)


def char_codes(text) -> Column:
    """Unicode code points of a string, one per character (a pure expression).

    Measured against an Arrow batch UDF doing one UTF-32 encode per string:
    no faster, so the work stays in the JVM.
    """
    return F.transform(F.filter(F.split(col_of(text), ""), lambda c: c != ""), lambda c: F.ascii(c))


def _position_ids_arrow(mask: "pa.Array") -> "pa.Array":
    if isinstance(mask, pa.ChunkedArray):
        mask = mask.combine_chunks()
    offsets = mask.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]  # a sliced array's values start at its first offset
    vals = mask.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    cs = np.cumsum(vals)
    before = np.concatenate([[0], cs])[offsets[:-1]]
    lengths = np.diff(offsets)
    out = cs - np.repeat(before, lengths) - 1
    out = np.where(vals == 0, 1, out).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out),
                                    mask=mask.is_null())


_position_ids_udf = F.arrow_udf(_position_ids_arrow, T.ArrayType(T.LongType()))


def position_ids(mask) -> Column:
    """Running sum of the mask minus one, and 1 wherever the mask is 0.

    One vectorised cumulative sum per Arrow batch (no per-row Python loop).
    """
    return _position_ids_udf(col_of(mask))
