"""The prefix trie of conversations, rolled up along its owners' lines.

Every conversation is rebuilt with the first turns of its family's first
conversation before its own later ones. A node of the trie is a distinct
sequence of first turns; its members are the rebuilt conversations that start
with it, and it is named by its smallest member and its depth.

Building. Turns are dealt out by range of (conversation, order), so a
conversation of any length spreads over tasks; a turn's place is its place in
its range plus what the ranges before it hold, from a table of one row a range
and conversation. A prefix is known by the exclusive-or of two 64-bit hashes of
each of its turns with its depth: 128 bits that add up in any grouping, so
running values need no pass over a whole conversation in one task. Members,
weights and byte counts of a node are plain grouped sums.

Rollup. A node's smallest member is also the smallest member of every deeper
node on its own path, so the nodes of one owner are a line: from the depth at
which it leaves a smaller owner's line down to its end. The forest of parent
edges is a much smaller tree of lines, and a node's total is what its line holds
from it on, with the whole totals of the lines that hang there.

- A line's own sum is a plain grouped sum. The lines' whole totals come by
  pointer doubling: in a turn every line adds its sum to the line it points at
  and then points where that one does, so the turns are the logarithm of how
  deep lines hang on lines (at most the square root of twice the rows). The
  line of the root takes no part, so what hangs on it doesn't meet in one key.
- Along a line totals are running sums from its end, in cells of ``_DEPTHS``
  depths first and then over the cells, so that a conversation of any length
  spreads over tasks.

Every turn is stored.

The digest of a node's ended members runs over their sorted ids: ranges of ids
become pieces of text first, which are then fed to SHA-256 in order; nothing is
held whole.

Defined cases: null roles and texts are empty; null turns come first; turns that
share a number are ordered by role (first 64 code points), text (first 256) and
hash; repeated rows are turns of their own; rows without a conversation id are
left out; ids must be integers (others raise at once); a conversation without
rebuilt turns belongs to the root only; columns that are not named are not
read; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready, stored

FAMILY, BORROWED = 5, 9
#: Ids in a piece of a digest's text, and depths that are summed as one cell.
_PIECE, _DEPTHS = 4096, 128


def _borrowed(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % BORROWED


def _turns(conversations: DataFrame) -> DataFrame:
    """``(conv, part, at, h1, h2, bytes)``: ``at`` counts a range's rows in order."""
    if not isinstance(conversations.schema["conv_id"].dataType, T.IntegralType):
        raise TypeError("conv_id must be an integer column")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.substring(role, 1, 64).alias("who"), F.substring(text, 1, 256).alias("start"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), text, role).alias("h2"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("tie"))
    order = ("conv", "turn", "who", "start", "h1", "tie")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return stored(dealt.select("conv", F.shiftright("at", 33).alias("part"), "at", "h1", "h2", "bytes"), "trie-turns")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, part, depth, g1, g2, bytes)`` of every rebuilt turn, and ``(conv, total)`` of every conversation."""
    turns = _turns(conversations)
    cells = stored(turns.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")), "trie-cells")
    own = cells.groupBy("conv").agg(F.sum("n").alias("n")).withColumns({"h": _borrowed(F.col("conv")), "p": F.col("conv") - F.col("conv") % FAMILY})
    given = own.select(F.col("conv").alias("p"), F.col("n").alias("given"))
    convs = own.join(given, "p", "left").withColumn("got", F.least("h", F.coalesce("given", F.lit(0))))
    convs = stored(convs.select("conv", "p", "h", "got", (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "trie-conversations")

    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges hold the conversation
    starts = cells.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(convs, "conv").select("conv", "part", (F.col("before") - F.col("first") + 1).alias("shift"), "h", "got")
    placed = turns.join(starts, ["conv", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
    after = placed.filter("pos > h").select("conv", "part", (F.col("pos") - F.col("h") + F.col("got")).alias("depth"), "h1", "h2", "bytes")
    lent = placed.filter(F.col("pos") < BORROWED).select(F.col("conv").alias("p"), "pos", "h1", "h2", "bytes")
    heads = convs.select("conv", "p", "got").join(lent, "p").filter("pos <= got").select("conv", F.lit(-1).cast("long").alias("part"), F.col("pos").alias("depth"), "h1", "h2", "bytes")
    rows = after.unionByName(heads)
    g1, g2 = (F.xxhash64(F.lit(k), "depth", "h1", "h2") for k in (3, 4))
    return stored(rows.select("conv", "part", "depth", g1.alias("g1"), g2.alias("g2"), "bytes"), "trie-rebuilt"), convs.select("conv", "total")


def _prefixes(conversations: DataFrame) -> DataFrame:
    """``(conv, depth, z1, z2, p1, p2, bytes, total)``: each conversation's prefixes, the empty one too, with their hashes and those of their parents."""
    rows, convs = rebuilt(conversations)
    xor = rows.groupBy("conv", "part").agg(F.bit_xor("g1").alias("x1"), F.bit_xor("g2").alias("x2"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = xor.select("conv", "part", *(F.coalesce(F.bit_xor(f"x{k}").over(earlier), F.lit(0)).alias(f"x{k}") for k in (1, 2))).join(convs, "conv")
    so_far = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumns({f"l{k}": F.bit_xor(f"g{k}").over(so_far) for k in (1, 2)}).join(before, ["conv", "part"])
    run = run.withColumns({f"z{k}": F.col(f"l{k}").bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)})
    turns = run.select("conv", "depth", "z1", "z2", *(F.col(f"z{k}").bitwiseXOR(F.col(f"g{k}")).alias(f"p{k}") for k in (1, 2)), "bytes", "total")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", zero.alias("depth"), zero.alias("z1"), zero.alias("z2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("bytes"), "total")
    return stored(turns.unionByName(roots), "trie-prefixes")


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes ``(k, d, up, n, weight, gain, kids)`` and the paths ``(conv, d, k, up, end)``.

    ``k`` is a node's smallest member, ``up`` its parent's; ``weight`` the rows
    of its members from it on, ``gain`` what sharing its last turn saves.
    """
    prefixes = _prefixes(conversations)
    met = prefixes.groupBy("depth", "z1", "z2").agg(F.min("conv").alias("k"), F.count("*").alias("n"), F.sum("total").alias("rows"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    met = stored(met, "trie-met")
    tops = met.select((F.col("depth") + 1).alias("depth"), F.col("z1").alias("p1"), F.col("z2").alias("p2"), F.col("k").alias("up"))
    named = stored(met.join(tops, ["depth", "p1", "p2"], "left"), "trie-named")
    kids = named.filter("depth > 0").groupBy(F.col("up").alias("k"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("kids"))
    nodes = named.join(kids, ["k", "depth"], "left").select(
        "k", F.col("depth").alias("d"), "up", "n", (F.col("rows") - F.col("n") * (F.col("depth") - 1)).alias("weight"),
        ((F.col("n") - 1) * F.col("bytes")).alias("gain"), F.coalesce("kids", F.lit(0)).alias("kids"))
    paths = prefixes.join(named.select("depth", "z1", "z2", "k", "up"), ["depth", "z1", "z2"])  # a plain join, of which Spark can split a prefix that very many share
    return stored(nodes, "trie-nodes"), stored(paths.select("conv", F.col("depth").alias("d"), "k", "up", (F.col("depth") == F.col("total")).alias("end")), "trie-paths")


def _line_totals(lines: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """``lines(k, ..., to, *values)`` with the sums of ``values`` over each line and all that hang on it, ``to`` by ``to``."""
    while lines.filter("to IS NOT NULL").take(1):
        moving = lines.filter("to IS NOT NULL")
        given = moving.groupBy(F.col("to").alias("k")).agg(*(F.sum(v).alias(f"more_{v}") for v in values))
        hops = moving.select(F.col("k").alias("to"), F.col("to").alias("next"))
        nexts = moving.select("k", "to").join(hops, "to").select("k", "next")  # a plain join, of which Spark can split a line on which very many hang
        lines = lines.join(given, "k", "left").join(nexts, "k", "left").withColumns({"to": F.col("next"), **{v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0)) for v in values}})
        lines = stored(lines.drop("next", *(f"more_{v}" for v in values)), "trie-lines")
    return lines


def subtree_totals(nodes: DataFrame, paths: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """``(k, d, *values)``: the sums of ``values`` over each node's subtree.

    ``nodes(k, d, ...)`` and ``paths(conv, d, k, up)`` as of ``trie``, paths of
    the nodes' owners at least.
    """
    sums = [F.sum(v).alias(v) for v in values]
    root = nodes.filter("d = 0").select("k").first() or (None,)
    # where each line but the root's leaves another, and what it holds; ``to`` is the line it points at, null for the root's
    edges = paths.filter("conv = k AND up <> k").select("k", F.col("d").alias("start"), "up", F.when(F.col("up") != root[0], F.col("up")).alias("to"))
    lines = stored(edges.join(nodes.groupBy("k").agg(*sums), "k"), "trie-lines")
    hung = _line_totals(lines, values).groupBy(F.col("up").alias("k"), (F.col("start") - 1).alias("d")).agg(*(F.sum(v).alias(f"more_{v}") for v in values))
    held = nodes.select("k", "d", *values).join(hung, ["k", "d"], "left")
    held = stored(held.select("k", "d", F.expr(f"d div {_DEPTHS}").alias("cell"), *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values)), "trie-held")
    later = Window.partitionBy("k").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the line has cells
    cells = held.groupBy("k", "cell").agg(*sums).select("k", "cell", *(F.coalesce(F.sum(v).over(later), F.lit(0)).alias(f"more_{v}") for v in values))
    below = Window.partitionBy("k", "cell").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return held.withColumns({v: F.sum(v).over(below) for v in values}).join(cells, ["k", "cell"]).select("k", "d", *((F.col(v) + F.col(f"more_{v}")).alias(v) for v in values))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (k, d, conv): the ids of a node, comma-joined in pieces, each with its first id."""
    names = ["k", "d", "first", "ids"]
    for b in batches:
        c = [b.column(i).to_numpy() for i in range(3)]
        if not len(c[0]):
            continue
        new = np.r_[True, (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])]
        at = np.flatnonzero(new)
        at = np.concatenate([np.arange(s, e, _PIECE) for s, e in zip(at, np.r_[at[1:], len(new)], strict=True)])
        conv = list(map(str, c[2].tolist()))
        texts = [",".join(conv[s:e]) for s, e in zip(at.tolist(), [*at[1:].tolist(), len(conv)], strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in c), pa.array(texts)], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted pieces: the SHA-256 of a node's ids, fed piece by piece."""
    node = state = None

    def done(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in out], pa.int64()), pa.array([x[0][1] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["k", "d", "sha"])

    for b in batches:
        out = []
        for k, d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            if (k, d) == node:
                state.update(b",")
            else:
                if state:
                    out.append((node, state.hexdigest()))
                node, state = (k, d), sha256()
            state.update(ids.encode())
        yield done(out)
    if state:
        yield done([(node, state.hexdigest())])


def end_digests(paths: DataFrame) -> DataFrame:
    """``(k, d, sha)`` of nodes at which conversations end: over their ids in numeric order."""
    order = ("k", "d", "conv")
    ends = ready(paths).filter("end").select(*order)
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "k long, d long, first long, ids string")
    return pieces.repartition("k", "d").sortWithinPartitions("k", "d", "first").mapInArrow(_digests, "k long, d long, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    nodes, paths = trie(conversations)
    values = nodes.select("k", "d", (F.col("kids") == 0).cast("long").alias("leaves"), F.col("gain").alias("saved"))
    totals = subtree_totals(values, paths, ("leaves", "saved"))
    out = nodes.join(totals, ["k", "d"]).join(end_digests(paths), ["k", "d"], "left")
    return out.select(F.col("k").alias("conv_id"), F.col("d").alias("depth"), F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
                      F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
