"""The prefix trie against a plain one in Python."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tunetable.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"


def brute(rows):
    """The contract's rows from ``(conv, turn, role, text)``."""
    turns = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            turns[c].append((n is not None, n or 0, role or "", text or ""))
    seqs = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        own, lent = (sorted(turns.get(x, ())) for x in (c, first))
        seqs[c] = tuple((r, t) for *_, r, t in lent[:h] + own[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for s in members:
        if s:
            kids[s[:-1]] += 1
    for s, m in members.items():
        gain = (len(m) - 1) * len(s[-1][1].encode()) if s else 0
        for d in range(len(s) + 1):
            saved[s[:d]] += gain
            leaves[s[:d]] += not kids[s]
    ends = {s: ",".join(str(c) for c in sorted(m) if seqs[c] == s) for s, m in members.items()}
    return {(min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], sha256(ends[s].encode()).hexdigest()) for s, m in members.items()}


def got(df):
    rows = [tuple(r) for r in prefix_trie.prefix_trie(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


SCHEMA = "conv_id long, turn int, role string, text string"


def test_awkward_rows(spark):
    long = "y" * 200_000
    rows = [(0, 1, "user", "hi"), (0, 2, None, "there"), (0, None, "system", None), (0, 3, "user", long), (1, 1, "user", "own"), (1, 1, "assistant", "tie"), (1, 1, "user", "own"),
            (7, None, None, None), (7, None, "a", "b"), (9, 5, "user", "family without a first"), (-3, 1, "user", "negative"), (None, 1, "user", "no id"), (None, None, None, None),
            (12, 1, "user", "hi"), (13, 1, "user", "hi")]
    clash = ("conv", "part", "at", "depth", "k", "d", "up", "weight", "total", "who", "tie", "end", "h")
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in clash)).repartition(3)
    assert got(df) == brute(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).collect() == []
    assert prefix_trie.prefix_trie(df.filter("conv_id IS NULL")).collect() == []
    assert got(df.filter("conv_id = 9")) == brute([r for r in rows if r[0] == 9])
    with pytest.raises(TypeError):
        prefix_trie.prefix_trie(df.withColumn("conv_id", F.col("conv_id").cast("string")))


def test_long_and_copied_conversations(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(10, t, "user", f"long {t}") for t in range(700)]  # one conversation holds most rows
    rows += [(11, t, "user", f"long {t}") for t in range(300)] + [(12, t, "user", f"long {t}" if t < 150 else f"other {t}") for t in range(260)]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 140) for t in range(9)]  # a group of copies
    rows += [(c, t, rnd.choice("ab"), rnd.choice("xyz")) for c in range(200, 260) for t in range(rnd.randrange(1, 12))]
    rnd.shuffle(rows)
    monkeypatch.setattr(prefix_trie, "_DEPTHS", 7)
    monkeypatch.setattr(prefix_trie, "_PIECE", 3)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_turns_halve_the_weights(spark, monkeypatch):
    rows = [(0, t, "user", str(t)) for t in range(200)]
    nodes, paths = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))
    names = []
    real = prefix_trie.stored
    monkeypatch.setattr(prefix_trie, "stored", lambda df, name, *a: (names.append(name), real(df, name, *a))[1])
    out = prefix_trie.subtree_totals(nodes.select("k", "d", "weight", F.col("n").alias("v")), paths, ("v",))
    assert {(r.d, r.v) for r in out.collect()} == {(d, 201 - d) for d in range(201)}
    assert names.count("trie-moved") <= 8  # 201 nodes in a line


def test_turns_are_the_logarithm_of_hanging_lines(spark, monkeypatch):
    stairs = [(5 * c, t, "user", str(t) if t < 8 * c + 8 else "own") for c in range(1, 41) for t in range(8 * c + 9)]  # each line hangs on the one before
    names = []
    real = prefix_trie.stored
    monkeypatch.setattr(prefix_trie, "stored", lambda df, name, *a: (names.append(name), real(df, name, *a))[1])
    monkeypatch.setattr(prefix_trie, "_DEPTHS", 7)
    assert got(spark.createDataFrame(stairs, SCHEMA).repartition(3)) == brute(stairs)
    assert names.count("trie-lines") <= 7  # 39 lines in a row
    names.clear()
    rows = [(0, t, "user", str(t)) for t in range(200)] + [(c, t, "user", f"{c} {t}") for c in range(5, 200, 5) for t in range(9)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert names.count("trie-lines") == 1 and len(names) <= 11  # long lines and many on the root take no turns


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.QUERIES["op11_conversation_prefix_trie"](spark, SF).collect()} == brute(rows)
