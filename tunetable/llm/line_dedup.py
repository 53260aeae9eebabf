"""Line dedup: every line of a key that several documents hold goes, except in the first of them.

A line's key is the line without white space at both ends, A-Z lower-cased;
keys of at least ``LEAST`` code points count. Rows (128-bit hash of the key,
document, position) are range-partitioned with document and position as
secondary sort keys, so even a line that half of the corpus holds is spread
over ranges. Each task streams its range and compares a row's document with
that of the first row of its key, in constant memory; no text is shuffled for
it. A key may begin in an earlier range: each task hands over the first
document of its first and last key and the rows that are first in its first
key, and a small join settles these.

The result per document is a compressed bitmap of the lines to keep, one bit a
line, not text.

Defined cases: null or empty text is one empty line; null ids come after all
others; rows that share an id are one document; repeated rows get equal
results; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, ascii_lower, ready, stored

#: Code points from which on a key counts.
LEAST = 10
_DROP, _OPEN, _FIRST = 0, 1, 2
_FOUND = "kind int, h1 long, h2 long, late boolean, doc long, mark long, pos int"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(h1, h2, late, doc, mark, pos)`` of every line whose key counts; late: without an id."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("mark"), F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(SPACES)))
    keyed = lines.withColumn("key", key).filter(F.length("key") >= LEAST)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.col("doc").isNull().alias("late"), F.coalesce("doc", F.lit(0)).alias("doc"), "mark", "pos")


def _streamed(batches):
    """Of a sorted range: lines to drop, lines that an earlier range decides, first documents of its first and last key."""
    names = ["h1", "h2", "late", "doc", "mark", "pos"]
    key = first = None  # of the run that goes on
    opening = True  # still in the range's first run
    def rows(kind, at, c):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, dtype=np.int32)), *(pa.array(c[n][at]) for n in names)], names=["kind", *names])
    def firsts(k, f):
        return rows(_FIRST, np.arange(1), {"h1": np.array([k[0]]), "h2": np.array([k[1]]), "late": np.array([f[0]]), "doc": np.array([f[1]]), "mark": np.zeros(1, np.int64), "pos": np.zeros(1, np.int32)})
    for b in batches:
        if not b.num_rows:
            continue
        c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
        n = b.num_rows
        new = np.r_[key != (c["h1"][0], c["h2"][0]), (c["h1"][1:] != c["h1"][:-1]) | (c["h2"][1:] != c["h2"][:-1])]
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        if key is None:
            key, first = (c["h1"][0], c["h2"][0]), (c["late"][0], c["doc"][0])
            yield firsts(key, first)
            runs = np.cumsum(new) - 1
        else:
            runs = np.cumsum(new)
        late = np.where(start < 0, first[0], c["late"][start])
        doc = np.where(start < 0, first[1], c["doc"][start])
        drop = (doc != c["doc"]) | (late != c["late"])
        yield rows(_DROP, np.flatnonzero(drop), c)
        if opening:
            yield rows(_OPEN, np.flatnonzero(~drop & (runs == 0)), c)
            opening = runs[-1] == 0
        key, first = (c["h1"][-1], c["h2"][-1]), (late[-1], doc[-1])
    if key is not None:
        yield firsts(key, first)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(late, doc, mark, dropped)``: positions of the lines that go, for documents that lose any."""
    order = ["h1", "h2", "late", "doc", "mark", "pos"]
    keys = line_keys(ready(docs), id_col, text_col)
    found = stored(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_streamed, _FOUND), "lines")
    first = found.filter(F.col("kind") == _FIRST).groupBy("h1", "h2").agg(F.min(F.struct("late", "doc")).alias("first"))
    late = found.filter(F.col("kind") == _OPEN).join(first, ["h1", "h2"]).filter(F.struct("late", "doc") > F.col("first"))
    gone = found.filter(F.col("kind") == _DROP).select("late", "doc", "mark", "pos").unionByName(late.select("late", "doc", "mark", "pos"))
    return gone.groupBy("late", "doc", "mark").agg(F.collect_set("pos").alias("dropped"))  # bounded by the document's lines


@F.pandas_udf(T.BinaryType())
def _bitmap(n: pd.Series, dropped: pd.Series) -> pd.Series:
    out = []
    for lines, gone in zip(n, dropped, strict=True):
        keep = np.ones(lines, dtype=np.uint8)
        if gone is not None:
            keep[np.asarray(gone, dtype=np.int64)] = 0
        out.append(zlib.compress(np.packbits(keep).tobytes()))
    return pd.Series(out, dtype=object)


def bits(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n_lines)


def kept_text(text: str | None, bitmap: bytes) -> str:
    lines = (text or "").split("\n")
    return "\n".join(x for x, keep in zip(lines, bits(bitmap, len(lines)), strict=True) if keep)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_lines, n_dropped, keep_bitmap`` (zlib over packed bits), with ``text`` if asked for."""
    gone = dropped_lines(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("__mark"), F.col(text_col).alias("text"), F.size(split_lines(F.col(text_col))).cast("long").alias("n_lines"))
    same = (F.coalesce(rows["doc_id"].cast("long"), F.lit(0)) == gone["doc"]) & (rows["doc_id"].isNull() == gone["late"]) & (rows["__mark"] == gone["mark"])
    out = rows.join(gone, same, "left").withColumn("keep_bitmap", _bitmap("n_lines", "dropped"))
    lost = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long")
    return out.select("doc_id", "n_lines", lost.alias("n_dropped"), "keep_bitmap", *["text"] * with_text)


@F.pandas_udf(T.StringType())
def kept_sha256(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    from hashlib import sha256

    return pd.Series([sha256(kept_text(t, b).encode("utf-8", "surrogatepass")).hexdigest() for t, b in zip(text, bitmap, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def kept_lines(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    return pd.Series([kept_text(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)
