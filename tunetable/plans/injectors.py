"""Named injector chains (X1): ordered steps that read ``in`` columns and add ``out`` columns.

The chain is validated against the schema before any job starts: a missing
input or an output that already exists is an error. Each step becomes one
``DataFrame.transform``, so the whole chain is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, lengths, text

REGISTRY: dict[str, Callable] = {}


def injector(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _list(x):
    return [x] if isinstance(x, str) else list(x)


@injector("normalise_text")
def _norm(df, ins, outs, **kw):
    return df.withColumn(outs[0], text.normalise_text(ins[0]))


@injector("char_codes")
def _codes(df, ins, outs, **kw):
    return df.withColumn(outs[0], arrays.char_codes(ins[0]))


@injector("bpe_encode")
def _bpe(df, ins, outs, tokenizer=None, **kw):
    from ..functions.bpe import bpe_encode
    from ..resources import default_tokenizer_path
    return df.withColumn(outs[0], bpe_encode(ins[0], tokenizer or default_tokenizer_path()))


@injector("pad_or_truncate")
def _pad(df, ins, outs, n=500, fill=0, **kw):
    return df.withColumn(outs[0], arrays.pad_or_truncate(ins[0], n, fill))


@injector("align_inputs_targets")
def _align(df, ins, outs, start=arrays.START_CODE, stop=arrays.STOP_CODE, **kw):
    i, t = arrays.align_inputs_targets(arrays.append_stop(ins[0], stop), start, stop)
    return df.withColumn(outs[0], i).withColumn(outs[1], t)


@injector("mask_past_end")
def _mask(df, ins, outs, compression=1024, stop=arrays.STOP_CODE, **kw):
    return df.withColumn(outs[0], arrays.mask_past_end(ins[0], ins[1], compression, stop))


@injector("fix_codes")
def _fix(df, ins, outs, **kw):
    return df.withColumn(outs[0], arrays.fix_codes(ins[0]))


@injector("trim_calm_run")
def _trim(df, ins, outs, **kw):
    return df.withColumn(outs[0], arrays.trim_calm_run(ins[0]))


@injector("code_length")
def _clen(df, ins, outs, **kw):
    return df.withColumn(outs[0], lengths.code_length(ins[0]))


@injector("size")
def _size(df, ins, outs, **kw):
    return df.withColumn(outs[0], F.size(ins[0]))


ELEMENT: dict[str, Callable] = {
    "normalise_text": text.normalise_text,
    "char_codes": arrays.char_codes,
    "fix_codes": arrays.fix_codes,
    "trim_calm_run": arrays.trim_calm_run,
    "pad_or_truncate": lambda x, n=500, fill=0: arrays.pad_or_truncate(x, n, fill),
    "crop_or_pad": lambda x, n=500, start=0: arrays.crop_or_pad(x, n, start),
    "code_length": lengths.code_length,
    "size": F.size,
}


@injector("for_each")
def _each(df, ins, outs, subtype=None, **kw):
    """Apply the transform named ``subtype`` to every element of an array column."""
    return df.withColumn(outs[0], arrays.for_each(ins[0], lambda x: ELEMENT[subtype](x, **kw)))


@injector("discrete_token")
def _discrete(df, ins, outs, codebook=None, code="code", vector="embedding", id_col="__row", **kw):
    """Nearest codebook entry of a vector column, or of every vector of an array of vectors.

    ``codebook`` is a DataFrame of ``(code, vector)``. Each row's vectors are numbered, given codes
    by ``assign_codes`` and put back in order; ``id_col`` names a key column of ``df``.
    """
    from ..operators.codes import assign_codes
    nested = df.schema[ins[0]].dataType.elementType.simpleString().startswith("array")
    vectors = F.col(ins[0]) if nested else F.array(F.col(ins[0]))
    parts = df.select(F.col(id_col).alias("__key"), F.posexplode(vectors).alias("__pos", "__vec"))
    coded = assign_codes(parts.select(F.struct("__key", "__pos").alias("__at"), "__vec"),
                         codebook.select(F.col(code).alias("code"), F.col(vector).alias("embedding")), "__at", "__vec")
    seqs = coded.groupBy(F.col("__at.__key").alias("__key")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("__at.__pos").alias("p"), F.col("code").alias("c")))).alias("__c"))
    got = F.transform("__c", lambda s: s["c"])
    return df.join(seqs, df[id_col].eqNullSafe(seqs["__key"]), "left").withColumn(
        outs[0], got if nested else F.get(got, F.lit(0))).drop("__key", "__c")


def validate(columns, steps) -> None:
    have = set(columns)
    for k, st in enumerate(steps):
        typ = st.get("type")
        if typ not in REGISTRY:
            raise ValueError(f"step {k}: unknown injector type {typ!r}")
        if typ == "for_each" and st.get("subtype") not in ELEMENT:
            raise ValueError(f"step {k}: for_each needs a known subtype, not {st.get('subtype')!r}")
        for c in _list(st["in"]):
            if c not in have:
                raise ValueError(f"step {k} ({typ}): missing input column {c!r}")
        for c in _list(st["out"]):
            if c in have:
                raise ValueError(f"step {k} ({typ}): output column {c!r} already exists")
            have.add(c)


def run_injectors(df: DataFrame, steps) -> DataFrame:
    """Apply the validated chain of steps, in order."""
    validate(df.columns, steps)
    for st in steps:
        params = {k: v for k, v in st.items() if k not in ("type", "in", "out")}
        fn = REGISTRY[st["type"]]
        ins, outs = _list(st["in"]), _list(st["out"])
        df = df.transform(lambda d, fn=fn, ins=ins, outs=outs, params=params: fn(d, ins, outs, **params))
    return df
