"""Near duplicates through an LSH forest over MinHash signatures.

Every document gets ``TREES * DEPTH`` MinHash values of its set of 5-word
shingles. Documents with the same set are one class; one representative of it
goes on. Each tree is a sorted order of the signatures: rows (tree, its DEPTH
values, representative) are range-partitioned with the representative as the
last key, so a region with very many equal prefixes spreads over tasks.
Candidates are neighbours by longest common prefix: the rows just before, and
the least document of the run at every prefix length from LEAST on, so the
depth that counts adapts to how crowded a region is, and a run of n documents
gives O(n) pairs. Edges of the ranges are compared once more among themselves.

Candidates whose 128 signature bytes agree too little for the similarity (five
standard errors below) or whose sizes exclude it are put aside. The others are
confirmed on the full sets, in three turns: each document's best, the best
between any two components, and at last every one between different
components. A pair inside one component can't change the result and isn't
looked at again.

In a crowded run (more than BEFORE + 1 rows equal to depth LEAST, or a run at
the end of a range) neighbours are not all pairs. The documents of such runs
are joined once more, exactly, by the first of their shingles, those that few
components hold before the others, which leaves out pairs inside a component.
So every pair that is equal to depth LEAST in some tree is compared or ruled
out by its sizes and signatures; of pairs at the threshold, 2 in a million
share no such run (1 - 0.75^2 to the power of 16).

Defined cases: documents without words are linked with nothing and stay; null
ids come after all others and are told apart by row; rows that share an id are
one document, told by one of their texts; repeated rows are in the same class; other columns are not read;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, WordHasher, grams, mix, ready, stored, words
from .components import components

TREES, DEPTH, LEAST, BEFORE = 16, 8, 2, 3
SHINGLE, SIMILAR = 5, 0.75
_ERRORS = 5
#: From here on stand numbers of rows without an id.
_NO_ID = 1 << 62


def shingles(text: str | None, hasher: WordHasher) -> np.ndarray:
    """The numbers of the text's distinct shingles, sorted."""
    ws = words(text)
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(grams(hasher(ws), min(SHINGLE, len(ws))))


def _salts() -> np.ndarray:
    return mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """``TREES * DEPTH`` MinHash values of a set; long sets in pieces."""
    salts = _salts()
    out = np.full(len(salts), 0xFFFFFFFF, dtype=np.uint64)
    for k in range(0, len(s), 2048):
        x = (s[k:k + 2048, None] * salts[None, :])
        out = np.minimum(out, ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).min(axis=0))
    return out.astype(">u4")


def _sketched(batches):
    from xxhash import xxh3_128_digest

    hasher = WordHasher()
    for b in batches:
        n, keys, sigs = [], [], []
        for t in b.column("text"):
            s = shingles(t.as_py(), hasher)
            n.append(len(s))
            keys.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "mark", "n_shingles", "set_key", "sig"])


def _planted(batches):
    """Rows of the forest: a row per tree."""
    for b in batches:
        sig = np.frombuffer(b"".join(x.as_py() for x in b.column("sig")), dtype="V%d" % (4 * DEPTH))
        reps = np.repeat(b.column("rep").to_numpy(zero_copy_only=False), TREES)
        trees = np.tile(np.arange(TREES, dtype=np.int32), b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(trees), pa.array(sig.tolist(), pa.binary()), pa.array(reps)], names=["tree", "key", "rep"])


_NEAR = "a long, b long, tree int, key binary"


def _neighbours(batches):
    """Candidate pairs (a < b) of a sorted range; the rows at its ends with the heads of their runs (b null); the
    rows of runs whose pairs aren't all among the candidates, or that may go on outside (b and key null)."""
    bs = [b for b in batches if b.num_rows]
    if not bs:
        return
    t = pa.Table.from_batches(bs)
    tree, rep = t["tree"].to_numpy(), t["rep"].to_numpy()
    raw = t["key"].to_pylist()
    key = np.frombuffer(b"".join(raw), dtype=">u4").reshape(-1, DEPTH)
    same = (key[1:] == key[:-1]) & (tree[1:] == tree[:-1])[:, None]
    lcp = np.r_[0, np.logical_and.accumulate(same, axis=1).sum(axis=1)]
    pairs, ends = [np.zeros((0, 2), dtype=np.int64)], {0, len(rep) - 1}
    shared = lcp.copy()
    for back in range(1, min(BEFORE, len(rep) - 1) + 1):
        if back > 1:
            shared = np.r_[0, np.minimum(shared[:-1], lcp[1:])]
        at = np.flatnonzero(shared >= LEAST)
        at = at[at >= back]
        pairs.append(np.stack([rep[at - back], rep[at]], 1))
        shared = np.minimum(shared, lcp)
    for d in range(LEAST, DEPTH + 1):
        start = np.flatnonzero(lcp < d)
        size = np.diff(np.r_[start, len(rep)])
        order = np.lexsort((rep, np.repeat(start, size)))
        head = np.repeat(order[start], size)
        pairs.append(np.stack([rep[head], rep], 1)[np.repeat(size, size) > 1])
        if d == LEAST:
            ends |= {int(head[0]), int(head[-1])}
            open_ = np.repeat(size, size) > BEFORE + 1
            open_[:size[0]] = open_[-size[-1]:] = True
    p = np.sort(np.concatenate(pairs), axis=1)
    p = np.unique(p[p[:, 0] != p[:, 1]], axis=0)
    none = np.zeros(len(p), dtype=np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(none), pa.nulls(len(p), pa.binary())], names=["a", "b", "tree", "key"])
    crowd = np.unique(rep[open_])
    yield pa.RecordBatch.from_arrays([pa.array(crowd), pa.nulls(len(crowd), pa.int64()), pa.nulls(len(crowd), pa.int32()), pa.nulls(len(crowd), pa.binary())], names=["a", "b", "tree", "key"])
    e = sorted(ends)
    yield pa.RecordBatch.from_arrays([pa.array(rep[e]), pa.nulls(len(e), pa.int64()), pa.array(tree[e]), pa.array([raw[i] for i in e], pa.binary())], names=["a", "b", "tree", "key"])


@F.pandas_udf(T.IntegerType())
def _agree(x: pd.Series, y: pd.Series) -> pd.Series:
    width = TREES * DEPTH
    both = [np.frombuffer(b"".join(c), dtype=np.uint8).reshape(-1, width) for c in (x, y)]
    return pd.Series((both[0] == both[1]).sum(axis=1), dtype="int32")


@F.pandas_udf(T.BinaryType())
def _low_bytes(sig: pd.Series) -> pd.Series:
    return pd.Series([b[3::4] for b in sig], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _sets(text: pd.Series) -> pd.Series:
    hasher = WordHasher()
    return pd.Series([shingles(t, hasher).view(np.int64) for t in text], dtype=object)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored rows ``doc_id, mark, n_shingles, set_key, sig, node``; key and signature null without words."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = ready(docs).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_sketched, f"doc_id {kind}, mark long, n_shingles long, set_key binary, sig binary")
    return stored(out.withColumn("node", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID) + F.monotonically_increasing_id())), "near-sketches")


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b)``, a < b, from the forest over ``classes(rep, sig)``, and ``(node)`` whose runs hold other pairs too."""
    forest = classes.select("rep", "sig").mapInArrow(_planted, "tree int, key binary, rep long")
    order = ("tree", "key", "rep")
    found = stored(forest.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, _NEAR), "near-found")
    ends = found.filter("b IS NULL AND key IS NOT NULL").select("tree", "key", F.col("a").alias("rep")).distinct()  # a few rows of each range
    more = ends.repartition(1).sortWithinPartitions(*order).mapInArrow(_neighbours, _NEAR)
    crowd = found.filter("b IS NULL AND key IS NULL").select(F.col("a").alias("node")).distinct()
    return found.unionByName(more).filter("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b"), crowd


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough: 100 * intersection >= 75 * union."""
    x, y = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").withColumn("n", both).filter(F.col("n") * 100 >= (F.size("x") + F.size("y") - F.col("n")) * round(100 * SIMILAR)).select("a", "b")


def _across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of different components, with these as ca and cb (ca < cb)."""
    a, b = (groups.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    out = pairs.join(a, "a", "left").join(b, "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
    return out.filter("ca <> cb").select("a", "b", "agree", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))


def _overlapping(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: every pair of different components that can be similar enough, by an exact prefix join.

    Each set is ordered by the number of components that hold a shingle. Two
    sets of sizes x and y need an overlap of o = 75 (x + y) / 175, so they share
    one of the first x - o + 1 of the one and y - o + 1 of the other. What one
    component holds alone comes first and joins nothing.
    """
    own = sets.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("c"), F.size("s").alias("n"), F.explode("s").alias("s"))
    held = own.groupBy("s", "c").agg(F.count("*").alias("k")).groupBy("s").agg(F.count("*").alias("w")).filter("w > 1")
    several = own.join(stored(held, "near-several"), "s").groupBy("node", "c", "n").agg(F.sort_array(F.collect_list(F.struct("w", "s"))).alias("l"))  # bounded by the document's set
    part = round(100 * SIMILAR)
    first = several.select("node", "c", "n", (F.col("n") - F.size("l")).alias("alone"), F.posexplode("l").alias("p", "x"))
    first = first.select("node", "c", "n", (F.col("alone") + F.col("p")).alias("p"), F.col("x.s").alias("s")).filter((F.col("n") - F.col("p")) * 100 >= F.col("n") * part)
    first = stored(first, "near-first")
    at = first.groupBy("s", "c").agg(F.max(F.col("n") - F.col("p")).alias("r"), F.min("n").alias("n"), F.max("n").alias("m"))
    a, b = (at.select("s", *(F.col(x).alias(f"{x}{k}") for x in ("c", "r", "n", "m"))) for k in "ab")
    two = a.join(b, (a["s"] == b["s"]) & (F.col("ca") < F.col("cb")) & (F.col("ma") * 100 >= F.col("nb") * part) & (F.col("mb") * 100 >= F.col("na") * part)
                 & (F.least("ra", "rb") * (100 + part) >= (F.col("na") + F.col("nb")) * part)).select(a["s"], "ca", "cb")
    a, b = (first.select("s", *(F.col(x).alias(f"{x}{k}") for x in ("node", "c", "n", "p"))) for k in "ab")
    found = stored(two, "near-two").join(a, ["s", "ca"]).join(b, ["s", "cb"])
    need = (F.col("na") + F.col("nb")) * part
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * (100 + part)
    found = found.filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * part) & (left >= need))
    return found.groupBy(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).agg(F.count("*").alias("n")).select("a", "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept, mark`` (a hash of the text)."""
    rows = sketches(docs, id_col, text_col)
    classes = rows.filter("sig IS NOT NULL").groupBy("set_key").agg(F.min("node").alias("rep"), F.min_by("sig", "node").alias("sig"), F.first("n_shingles").alias("n"))
    classes = stored(classes, "near-classes")
    traits = classes.select("rep", "n", _low_bytes("sig").alias("bytes"))
    a, b = (traits.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("bytes").alias(f"s{k}")) for k in "ab")
    enough = SIMILAR - _ERRORS * (SIMILAR * (1 - SIMILAR) / (TREES * DEPTH)) ** 0.5

    def likely(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(a, "a").join(b, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * round(100 * SIMILAR))
        return pairs.withColumn("agree", _agree("sa", "sb")).filter(F.col("agree") >= int(enough * TREES * DEPTH)).select("a", "b", "agree")

    met, crowd = candidates(classes)
    close, crowd = stored(likely(met), "near-close"), stored(crowd, "near-crowd")

    nodes = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).unionByName(crowd).distinct()
    owners = rows.filter("sig IS NOT NULL").join(nodes, "node", "left_semi").groupBy("node", "doc_id").agg(F.min("mark").alias("mark"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__mark"))
    texts = owners.join(texts, owners["doc_id"].eqNullSafe(texts["__id"]) & (owners["mark"] == texts["__mark"]))
    sets = stored(texts.dropDuplicates(["node"]).select("node", _sets("__text").alias("s")), "near-sets")

    either = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    best = either.groupBy("a").agg(F.max(F.struct("agree", (-F.col("b")).alias("b"))).alias("m")).select(F.least("a", -F.col("m.b")).alias("a"), F.greatest("a", -F.col("m.b")).alias("b")).distinct()
    links = stored(_confirmed(best, sets), "near-links")
    groups = components(links)
    left = stored(_across(close.join(best, ["a", "b"], "left_anti"), groups), "near-left")
    if left.take(1):
        between = left.groupBy("ca", "cb").agg(F.max(F.struct("agree", "a", "b")).alias("m")).select("m.a", "m.b")
        links = stored(links.unionByName(_confirmed(between, sets)), "near-links")
        groups = components(links)
        left = stored(_across(left.join(between, ["a", "b"], "left_anti").select("a", "b", "agree"), groups), "near-left")
        if left.take(1):
            links = stored(links.unionByName(_confirmed(left, sets)), "near-links")
            groups = components(links)
    missed = stored(_confirmed(likely(_overlapping(sets.join(crowd, "node", "left_semi"), groups)), sets), "near-missed")
    if missed.take(1):
        groups = components(links.unionByName(missed))

    of = classes.select("set_key", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("set_key", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "mark", "n_shingles", "set_key", "node").join(of, "set_key", "left").withColumn("component", F.coalesce("component", "node"))
    kind = docs.schema[id_col].dataType
    return out.select("doc_id", "n_shingles", F.when(F.col("component") < _NO_ID, F.col("component")).cast(kind).alias("component_id"), (F.col("node") == F.col("component")).alias("kept"), "mark")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay (one document of each component), with all their columns.

    Rows are found again by id and text. Of rows without an id that have one
    text with words, one stays if their text does; such rows without words all
    stay, and so do repeated rows of a document that stays.
    """
    kept = near_groups(docs, id_col, text_col).groupBy("doc_id", "mark").agg(F.max("kept").alias("any"))
    gone = kept.filter("NOT any").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
    rows = docs.withColumn("__key", F.xxhash64(text_col))
    rows = rows.join(gone, rows[id_col].eqNullSafe(gone["__id"]) & (rows["__key"] == gone["__mark"]), "left_anti")
    lone = F.col(id_col).isNull() & (F.btrim(F.coalesce(text_col, F.lit("")), F.lit(SPACES)) != "")
    first = rows.filter(lone).withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy("__key"))).filter("__n = 1")
    return rows.filter(~lone).unionByName(first.drop("__n")).select(*docs.columns)
