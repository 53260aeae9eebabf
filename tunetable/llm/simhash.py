"""Near duplicates by SimHash, through a self-join of the fingerprints' binary trie.

A text's words are runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased; its shingles
are three words in a row joined by blanks, repeats included (fewer words: the
whole sequence). A fingerprint bit is 1 if it is set in more than half of the
shingles' XXH64 numbers (seed 42). Documents whose fingerprints differ in at
most ``BUDGET`` bits are linked.

The distinct fingerprints form a binary trie. The join walks pairs of its
nodes from the pair (root, root) down, a few levels a turn: a pair's children
are met with each other, the bits in which they differ are added to those of
the pair, and a pair above the budget is cut with all that lies below. A node
with one fingerprint below it is not opened further (path compression); two
such nodes are compared in full. Every turn is two joins on the node and a
stored table of the pairs still open.

A node has at most as many partners as there are masks of ``BUDGET`` bits, a
fingerprint at most 2,080, however the documents are spread: no key of these
joins grows with a group of copies, and the pairs grow with the number of
distinct fingerprints, not with its square. Copies share a fingerprint and
enter the trie once.

Defined cases: null or empty texts, and those without words, have the
fingerprint zero, linked like any other; a row without an id belongs to the
component of its fingerprint, and a component without any id has none; rows
that share an id each follow their own text; repeated rows get equal results;
other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stored, words
from .components import components

BUDGET, SHINGLE, SEED = 2, 3, 42
#: Levels of the trie that the turns go down, 64 in all. Pairs are few near the root, and below the levels at which most nodes hold one fingerprint.
STRIDES = (8, 4, 4, 4, 4, 8, 8, 8, 8, 8)

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The text's 64-bit fingerprint as an unsigned number."""
    from xxhash import xxh64_intdigest

    ws = words(text)
    if not ws:
        return 0
    joined, k = b" ".join(ws), min(SHINGLE, len(ws))
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.r_[0, ends[:-1]][:len(ws) - k + 1].tolist()
    h = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, (ends[k - 1:] - 1).tolist(), strict=True)), "<u8", len(starts))
    column = h.view(np.uint8).reshape(-1, 8)
    out = 0
    for byte in range(8):
        n = np.bincount(column[:, byte], minlength=256) @ _BITS
        out |= sum(1 << (8 * byte + i) for i in np.flatnonzero(2 * n > len(h)).tolist())
    return out


def _fingerprints(batches):
    for b in batches:
        prints = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], names=["doc_id", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, print)`` of every row, the 64 bits as a long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return ready(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(_fingerprints, f"doc_id {kind}, print long")


def _nodes(prints: DataFrame, depth: int, stride: int) -> DataFrame:
    """``(node, kids)``: the trie's nodes at a depth with their children ``stride`` levels down, at most ``2 ** stride``.

    A child is its prefix and, if it holds one fingerprint only, that one.
    """
    node = F.shiftrightunsigned("print", 64 - depth) if depth else F.lit(0).cast("long")
    low = depth + stride
    kid = F.shiftrightunsigned("print", 64 - low) if low < 64 else F.col("print")
    kids = prints.groupBy(node.alias("node"), kid.alias("kid")).agg(F.min("print").alias("least"), F.max("print").alias("most"))
    alone = F.when(F.col("least") == F.col("most"), F.col("least"))
    return kids.groupBy("node").agg(F.collect_list(F.struct("kid", alone.alias("alone"))).alias("kids"))


def close_prints(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``(a, b)``: all pairs of different fingerprints of the distinct ``prints(print)`` that differ in at most ``budget`` bits."""
    pairs, found, depth = None, [], 0
    for stride in STRIDES:
        nodes = _nodes(prints, depth, stride)
        left, right = (nodes.select(F.col("node").alias(n), F.col("kids").alias(f"{n}s")) for n in "xy")
        if pairs is None:  # the root with itself
            met = left.select("x", F.col("x").alias("y"), F.lit(0).alias("bits"), "xs", F.col("xs").alias("ys"))
        else:
            met = pairs.join(left, "x").join(right, "y")
        met = met.select("x", "y", "bits", F.explode("xs").alias("p"), "ys").select("x", "y", "bits", "p", F.explode("ys").alias("q"))
        met = met.filter((F.col("x") < F.col("y")) | (F.col("p.kid") < F.col("q.kid")) | ((F.col("p.kid") == F.col("q.kid")) & F.col("p.alone").isNull()))
        step = F.bit_count(F.col("p.kid").bitwiseXOR(F.col("q.kid")).bitwiseAND((1 << stride) - 1))
        met = met.select(F.col("p.kid").alias("x"), F.col("q.kid").alias("y"), (F.col("bits") + step).alias("bits"), F.col("p.alone").alias("a"), F.col("q.alone").alias("b"))
        met = met.filter(F.col("bits") <= budget).filter(F.coalesce(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= budget, F.lit(True)))
        met = stored(met, "sim-pairs")
        whole = F.col("a").isNotNull() & F.col("b").isNotNull()
        found.append(met.filter(whole).select("a", "b"))
        pairs = met.filter(~whole).select("x", "y", "bits")
        depth += stride
        if not pairs.take(1):
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def sim_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """Per row: ``doc_id, fingerprint`` (16 hex digits)``, component_id, kept``."""
    rows = stored(fingerprints(docs, id_col, text_col), "sim-prints")
    classes = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "sim-classes")
    groups = components(close_prints(classes.select("print"), budget)).withColumnRenamed("node", "print")
    placed = classes.join(groups, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of = stored(placed.join(least, "component").select("print", "component_id"), "sim-of")
    out = rows.join(of, "print")  # a plain join, of which Spark can split a hot fingerprint
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
