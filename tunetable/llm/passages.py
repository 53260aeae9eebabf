"""Passages of at least ``LEAST`` words that several documents share, by a sparse suffix array.

Of each document only suffixes at minimiser positions are kept: in every
window of ``SPREAD`` consecutive runs of ``RUN`` words the run with the least
hash. SPREAD + RUN - 1 = LEAST, so any two equal passages of LEAST words have
a minimiser at the same place in both. Two sorts follow:

1. (hash of the run, document, position), range-partitioned with the document
   in the key so that a very common run spreads over tasks; runs of one
   document only are left behind. No text is moved.
2. For the suffixes that are left, the words after the position (as 32-bit
   numbers, LEAST of them) are the sort key, the words before it come along.
   Each suffix is compared with its NEAR nearest documents on either side,
   matched words are counted to the right and to the left, and LEAST matched
   words make a passage. Longer passages are the union of what their
   minimisers find. Rows at the ends of the ranges are compared once more.

Order by the words to the right puts the longest match to the right next to a
suffix, not the longest one overall, and the NEAR nearest are all others only
for a run that at most NEAR + 1 documents hold, once each. Around runs that are
held more often every window of LEAST words is numbered, and windows with equal
numbers in several documents are matches: an exact way for those, in rows as
many as the words around such runs at most.

Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. A passage that repeats only
within one document is none.

Defined cases: null, empty and short texts have no passages; null ids come
after all others; rows that share id and text are one document; equal ids with
different texts are different documents; other columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHasher, mix, ready, stored, words

LEAST, RUN = 50, 16
SPREAD = LEAST - RUN + 1
#: Other documents on either side in the sorted order with which a suffix is compared.
NEAR = 6
_CHUNK = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_DOC = ["late", "doc", "mark"]
_CONTEXT = ["right", *_DOC, "before", "n_right", "n_before", "positions"]
_HEAVY = "right binary, late boolean, doc long, mark long, before binary, n_right int, n_before int, positions array<int>"


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """The number of each run of ``k`` words, from the words' numbers: runs of 1, 2, 4 ... words, put together by the bits of ``k``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, at, power, width = np.zeros(n, dtype=np.uint64), 0, h, 1
    while True:
        if k & width:
            out = mix(out * _ODD + power[at:at + n])
            at += width
        if at == k:
            return out
        power = mix(power[:-width] * _ODD + power[width:])
        width *= 2


def minimisers(g: np.ndarray) -> np.ndarray:
    """Positions of the least of every SPREAD consecutive numbers (the first of equals); none if there are fewer."""
    if len(g) < SPREAD:
        return np.zeros(0, dtype=np.int64)
    out = []
    for k in range(0, len(g) - SPREAD + 1, 4096):
        view = np.lib.stride_tricks.sliding_window_view(g[k:k + 4096 + SPREAD - 1], SPREAD)
        out.append(view.argmin(axis=1) + np.arange(k, k + len(view)))
    return np.unique(np.concatenate(out))


def _suffixes(batches):
    hasher = WordHasher()
    for b in batches:
        h, row, pos = [], [], []
        for i, t in enumerate(b.column("text")):
            g = runs(hasher(words(t.as_py())), RUN)
            at = minimisers(g)
            h.append(g[at].view(np.int64))
            row.append(np.full(len(at), i))
            pos.append(at)
        if h:
            of = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)), *(b.column(c).take(of) for c in _DOC), pa.array(np.concatenate(pos).astype(np.int32))], names=["h", *_DOC, "pos"])


def _whole(batches) -> pa.Table | None:
    bs = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(bs).combine_chunks() if bs else None


def _documents(t: pa.Table) -> np.ndarray:
    """For each row, whether it begins another document than the row before."""
    c = [t[n].to_numpy() for n in _DOC]
    return np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in c])]


def _shared(batches):
    """Rows whose run occurs in several documents; runs at the ends of the range stay, as they may go on outside.
    ``many``: the NEAR nearest of the second sort need not be all others (or the run may go on outside)."""
    t = _whole(batches)
    if t is None:
        return
    h = t["h"].to_numpy()
    new = np.r_[True, h[1:] != h[:-1]]
    run = np.cumsum(new) - 1
    held = np.bincount(run, weights=_documents(t) | new)
    several, many = held > 1, (held > NEAR + 1) | (np.bincount(run) > held)
    several[[0, -1]] = many[[0, -1]] = True
    yield from t.select([*_DOC, "pos"]).append_column("many", pa.array(many[run])).filter(pa.array(several[run])).to_batches()


def _windows(batches):
    """Every LEAST words of a document that hold the run of a position in ``crowd``: their number and where they start."""
    hasher = WordHasher()
    for b in batches:
        for i in range(b.num_rows):
            g = runs(hasher(words(b.column("text")[i].as_py())), LEAST)
            held = np.zeros(len(g), dtype=bool)
            for p in b.column("crowd")[i].values.to_numpy():
                held[max(0, p - LEAST + RUN):p + 1] = True
            at = np.flatnonzero(held)
            for k in range(0, len(at), _CHUNK):
                start = at[k:k + _CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array(g[start].view(np.int64)), *(pa.array([b.column(c)[i].as_py()] * len(start), b.column(c).type) for c in _DOC), pa.array(start.astype(np.int32))], names=["g", *_DOC, "start"])


def _contexts(batches):
    """The words to the right and, nearest first, to the left of a document's kept positions; positions with equal words on both sides share a row."""
    hasher = WordHasher()
    for b in batches:
        for i in range(b.num_rows):
            w = hasher(words(b.column("text")[i].as_py())).astype(">u4")
            at = np.sort(b.column("positions")[i].values.to_numpy())
            ends = np.stack([np.minimum(LEAST, len(w) - at), np.minimum(LEAST, at)], 1).astype(">u4")
            padded = np.r_[np.zeros(LEAST, dtype=">u4"), w, np.zeros(LEAST, dtype=">u4")]
            for k in range(0, len(at), _CHUNK):
                p = at[k:k + _CHUNK]
                rows = np.hstack([padded[p[:, None] + np.arange(LEAST, 2 * LEAST)], padded[p[:, None] + np.arange(LEAST - 1, -1, -1)], ends[k:k + _CHUNK]])
                same, of = np.unique(np.ascontiguousarray(rows, dtype=">u4").view(f"V{rows.shape[1] * 4}").ravel(), return_inverse=True)
                raw, n = same.tolist(), len(same)
                order = np.argsort(of, kind="stable")
                at_of = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of))].astype(np.int32)), pa.array(p[order].astype(np.int32)))
                sizes = np.frombuffer(b"".join(x[-8:] for x in raw), dtype=">u4").reshape(-1, 2).astype(np.int32)
                side = 4 * LEAST
                yield pa.RecordBatch.from_arrays([pa.array([x[:side] for x in raw], pa.binary()), *(pa.array([b.column(c)[i].as_py()] * n, b.column(c).type) for c in _DOC),
                                                  pa.array([x[side:-8] for x in raw], pa.binary()), pa.array(sizes[:, 0]), pa.array(sizes[:, 1]), at_of], names=_CONTEXT)


_MATCH = "late boolean, doc long, mark long, before_words int, after_words int, other_late boolean, other long, at array<int>, " + _HEAVY.replace("late ", "e_late ").replace(" doc ", " e_doc ").replace(" mark ", " e_mark ")
_MATCHED = ["late", "doc", "mark", "before_words", "after_words", "other_late", "other", "at"]


def _matched(rows, right, before, late, doc, mark, n_right, n_before, block, first, after):
    """Of the given rows: row, matching row, matched words before and after; of equal spans the one with the earliest other document."""
    n, i, j, down, up = len(doc), [], [], rows, rows
    for _ in range(NEAR):
        down = np.where(down >= 0, first[block[down]] - 1, -1)
        up = np.where(up < n, after[block[np.minimum(up, n - 1)]], n)
        for x in (down, up):
            inside = (x >= 0) & (x < n)
            i.append(rows[inside])
            j.append(x[inside])
    i, j = np.concatenate(i), np.concatenate(j)
    other = np.logical_or.reduce([x[i] != x[j] for x in (late, doc, mark)])
    i, j = i[other], j[other]

    def length(x, have):
        same = np.logical_and.accumulate(x[i] == x[j], axis=1).sum(axis=1)
        return np.minimum(same, np.minimum(have[i], have[j]))

    r, b = length(right, n_right), length(before, n_before)
    enough = (r + b >= LEAST) & (r >= RUN)
    i, j, r, b = i[enough], j[enough], r[enough], b[enough]
    order = np.lexsort((doc[j], late[j], r, b, i))
    i, j, r, b = i[order], j[order], r[order], b[order]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (i[1:] != i[:-1]) | (b[1:] != b[:-1]) | (r[1:] != r[:-1])
    return i[new], j[new], b[new], r[new]


def _compared(batches):
    """Matches of a sorted range, and the rows of its first and last document block for the comparison across ranges."""
    t = _whole(batches)
    if t is None:
        return
    n = t.num_rows
    right, before = (np.frombuffer(b"".join(t[c].to_pylist()), dtype=">u4").reshape(n, LEAST) for c in ("right", "before"))
    late, doc, mark, n_right, n_before = (t[c].to_numpy() for c in (*_DOC, "n_right", "n_before"))
    block = np.cumsum(_documents(t)) - 1
    first = np.flatnonzero(_documents(t))
    after = np.r_[first[1:], n]
    best = [_matched(np.arange(at, min(at + _CHUNK, n)), right, before, late, doc, mark, n_right, n_before, block, first, after) for at in range(0, n, _CHUNK)]
    own, far, b, r = (np.concatenate(x) for x in zip(*best, strict=True))
    own_positions = t["positions"].take(pa.array(own)).combine_chunks()
    nothing = [pa.nulls(len(own), t.schema.field(c).type) for c in _CONTEXT]
    names = [*_MATCHED, "right", "e_late", "e_doc", "e_mark", "before", "n_right", "n_before", "positions"]
    yield pa.RecordBatch.from_arrays([pa.array(late[own]), pa.array(doc[own]), pa.array(mark[own]), pa.array(b.astype(np.int32)), pa.array(r.astype(np.int32)), pa.array(late[far]), pa.array(doc[far]), own_positions, *nothing], names=names)
    for e in t.select(_CONTEXT).filter(pa.array((block < NEAR) | (block > block[-1] - NEAR))).combine_chunks().to_batches():
        none = [pa.nulls(e.num_rows, k) for k in (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), t.schema.field("positions").type)]
        yield pa.RecordBatch.from_arrays([*none, *e.columns], names=names)


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(late, doc, mark, start, stop, other_late, other)``: words start to stop of a document that another one holds too."""
    rows = ready(docs).select(F.col(id_col).isNull().alias("late"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    order = ["h", *_DOC, "pos"]
    found = stored(rows.mapInArrow(_suffixes, "h long, late boolean, doc long, mark long, pos int"), "passage-all")  # ranges are found by a pass of their own
    found = found.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(found.mapInArrow(_shared, "late boolean, doc long, mark long, pos int, many boolean"), "passage-suffixes")
    crowd = kept.filter("many").groupBy(*_DOC).agg(F.collect_set("pos").alias("crowd"))  # bounded likewise
    crowded = stored(rows.join(crowd, _DOC).dropDuplicates(_DOC).mapInArrow(_windows, "g long, late boolean, doc long, mark long, start int"), "passage-windows")
    kept = kept.groupBy(*_DOC).agg(F.collect_set("pos").alias("positions"))  # bounded by the document's suffixes
    order = ["right", *_DOC, "before"]
    heavy = rows.join(kept, _DOC).dropDuplicates(_DOC).mapInArrow(_contexts, _HEAVY)
    out = stored(heavy.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compared, _MATCH), "passage-matches")
    ends = out.filter("e_doc IS NOT NULL").select("right", *(F.col(f"e_{c}").alias(c) for c in _DOC), *_CONTEXT[4:])
    more = ends.repartition(1).sortWithinPartitions(*order).mapInArrow(_compared, _MATCH)  # a few documents of each range
    found = out.select(*_MATCHED).unionByName(more.select(*_MATCHED)).filter("doc IS NOT NULL").withColumn("p", F.explode("at"))
    found = found.select(*_DOC, (F.col("p") - F.col("before_words")).alias("start"), (F.col("p") + F.col("after_words")).alias("stop"), "other_late", "other")
    return found.unionByName(_equal_windows(crowded))


def _equal_windows(windows: DataFrame) -> DataFrame:
    """Matches of windows that several documents hold; the other one is the first of these, or the last for the first."""
    doc = F.struct(*_DOC)
    held = windows.groupBy("g").agg(F.min(doc).alias("first"), F.max(doc).alias("last")).filter("first <> last")
    both = windows.join(stored(held, "passage-equal"), "g")
    other = F.when(doc == F.col("first"), F.col("last")).otherwise(F.col("first"))
    return both.select(*_DOC, "start", (F.col("start") + LEAST).alias("stop"), other["late"].alias("other_late"), other["doc"].alias("other"))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shared passage of a document: ``doc_id, start_word, end_word`` (exclusive), ``n_words, other_doc_id``
    (one that holds a part of it), ``later`` (an earlier document holds a part of it)."""
    m = matches(docs, id_col, text_col)
    earlier = F.struct("other_late", "other") < F.struct("late", "doc")
    m = m.groupBy(*_DOC, "start", "stop").agg(F.min(F.struct("other_late", "other")).alias("o"), F.max(earlier).alias("later"))
    by = Window.partitionBy(*_DOC).orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= reach, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    spans = m.withColumn("island", island).groupBy(*_DOC, "island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("o").alias("o"), F.max("later").alias("later"))
    kind = docs.schema[id_col].dataType

    def shown(late, doc):
        return F.when(~F.col(late), F.col(doc)).cast(kind)

    return spans.select(shown("late", "doc").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), shown("o.other_late", "o.other").alias("other_doc_id"), "later")
