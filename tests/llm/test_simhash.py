"""SimHash: fingerprints, the trie join and the groups, against brute force."""

import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tunetable.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def brute_print(text):
    ws = (text or "").encode().lower().split()
    n = max(len(ws) - 2, 1)
    h = [xxhash.xxh64_intdigest(b" ".join(ws[i:i + 3]), 42) for i in range(n)] if ws else []
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def brute_groups(prints):
    """doc -> smallest doc reachable over pairs of at most two differing bits."""
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "a  b\tc d", "x " * 5000, "Ärger mit Ä ärger"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_close_prints_against_brute_force(spark):
    rnd = random.Random(3)
    prints = {rnd.getrandbits(64) for _ in range(300)} | {0, 1, 3, 7, 1 << 63, (1 << 64) - 1, (1 << 64) - 2}
    for p in list(prints)[:60]:
        prints |= {p ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for _ in range(6)}
    center = rnd.getrandbits(64)  # a crowded region: every pair shares nearly all of the trie
    prints |= {center ^ i for i in range(256)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = [tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.close_prints(spark.createDataFrame(signed, "print long")).collect()]
    ps = sorted(prints)
    want = {(a, b) for i, b in enumerate(ps) for a in ps[:i] if (a ^ b).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(8000))
    rows = [(3, None), (1, ""), (2, " \n"), (5, "One two three four"), (4, "one  TWO three\tfour"), (9, long), (8, long), (8, long), (None, long), (None, "only without an id here"), (7, "single")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in ("print", "component", "component_id", "node", "kid", "least", "a", "b", "bits")))
    got = simhash.sim_groups(df.repartition(3)).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(3, 1): 1, (1, 1): 1, (2, 1): 1, (5, 4): 1, (4, 4): 1, (9, 8): 1, (8, 8): 2, (None, 8): 1, (None, None): 1, (7, 7): 1})
    assert all(int(r.fingerprint, 16) == brute_print(t) for r in got for d, t in rows if d is not None and d == r.doc_id)
    assert simhash.sim_groups(df.limit(0)).collect() == []


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_print(r.text) for r in docs}
    groups = brute_groups(prints)
    got = queries.QUERIES["op13_simhash_near_dedup"](spark, SF).collect()
    assert {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got} == {(d, prints[d], groups[d]) for d in prints}
    assert len(set(groups.values())) < len(groups)
