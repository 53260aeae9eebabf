"""The flagship query against a brute-force pandas computation of the same question."""

import math
import re

import pandas as pd
import pytest

import __spark_entry__ as E
from tunetable.functions.bpe import load_tokenizer
from tunetable.resources import default_tokenizer_path

LIMITS = {"train": (350, 551250, 64), "val": (200, 286715, 13)}


def brute(sf):
    d = pd.read_parquet(f"{sf}/documents.parquet")
    tok = load_tokenizer(default_tokenizer_path())
    ws = re.compile(r"[ \t\n\r\f\x0b]+")
    phase_of = lambda i: "val" if i % 10 == 0 else "train"
    missing = {p: sum(1 for i in d.doc_id if i % 17 == 0 and phase_of(i) == p) for p in LIMITS}
    d = d[d.doc_id % 17 != 0]                       # lines whose clip exists
    out = {}
    for phase, g in d.assign(phase=["val" if i % 10 == 0 else "train" for i in d.doc_id]).groupby("phase"):
        mt, mw, batch = LIMITS[phase]
        text = g.text.str.replace("\n", " ", regex=False)
        tl = [len(tok.encode(ws.sub(" ", t.lower()).strip())) for t in text]
        wl = (g.n_chars * 100 + (g.doc_id % 7) * 60000).tolist()
        keep = [(a, b) for a, b in zip(tl, wl) if a <= mt and b <= mw]
        n = len(keep)
        out[phase] = (n, sum(a for a, _ in keep), sum(b for _, b in keep), math.ceil(n / batch),
                      math.ceil(n / (batch * 4)), len(tl) - n, missing[phase], 0)
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_phase_report_matches_brute_force(spark, sf):
    got = {r["phase"]: (r["n_examples"], r["n_tokens"], r["n_samples"], r["n_batches"], r["n_steps"], r["n_dropped"],
                        r["n_missing"], r["n_rejected"])
           for r in E.queries()["phase_report"](spark, sf).collect()}
    assert got == brute(sf)


def _encoded(sf):
    d = pd.read_parquet(f"{sf}/documents.parquet")
    tok = load_tokenizer(default_tokenizer_path())
    ws = re.compile(r"[ \t\n\r\f\x0b]+")
    return d, tok, {i: tok.encode(ws.sub(" ", t.lower()).strip()) for i, t in zip(d.doc_id, d.text)}


def test_bpe_queries_match_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    d, tok, enc = _encoded(sf)
    counts = {r["doc_id"]: (r["n_tokens"], r["n_unk"]) for r in E.queries()["bpe_token_counts"](spark, sf).collect()}
    assert counts == {i: (len(v), v.count(tok.unk_id) if tok.unk_id is not None else 0) for i, v in enc.items()}
    usage = {r["id"]: (r["token"], r["n"]) for r in E.queries()["vocab_usage"](spark, sf).collect()}
    from collections import Counter
    c = Counter(t for v in enc.values() for t in v)
    assert usage == {i: (tok.id_to_token[i], n) for i, n in c.items()}


def test_object_catalog_lists_every_table(spark):
    import os
    sf = "/root/testdata/sf0.01"
    rows = E.queries()["object_catalog"](spark, sf).collect()
    got = {os.path.basename(r["path"]): r["size"] for r in rows}
    assert got == {f: os.path.getsize(os.path.join(sf, f)) for f in os.listdir(sf) if f.endswith(".parquet")}
