"""Cross-tokenizer alignment against both libraries and a brute-force count of links."""

from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tunetable.llm import alignment, queries
from tunetable.llm.bpe_stream import byte_symbols

SF = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b \n\n c", "\nstart", "tab\tand  blanks   here ", "<|endoftext|> is <s> plain </s> <unk> <0x41>", "Ärger Größe naïve",
       "日本語のテキスト と 空白", "mark ▁ inside", "a▁b", "bad ﻿ sign 　 wide", "x" * 3000, "word " * 4000, "\x1c odd \x85 space \xa0 here", "é́ combining", "🙂 🙂🙂 emoji", "\x00 nul", "don't we'll I'M 12345 6,7"]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    back = {c: b for b, c in enumerate(byte_symbols())}
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]

    def both(text):
        """Ids and bytes of both sides, None where they don't give the text back."""
        if not text:
            return None
        x = a.encode(" " + text, add_special_tokens=False).ids
        y = b.encode(text)
        xs = [bytes(back[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(pieces[i][1:-1], 16)]) if b.is_byte(i) else pieces[i].replace("▁", " ").encode() for i in y]
        return (x, xs, y, ys) if b"".join(xs) == b"".join(ys) == (" " + text).encode() else None

    return both


def brute(both):
    """``(groups, links)`` from the byte offsets of whole texts."""
    x, xs, y, ys = both
    ends = []
    for ts in (xs, ys):
        at, out = 0, {}
        for i, t in enumerate(ts):
            at += len(t)
            out[at] = i
        ends.append(out)
    groups, links, i, j = [], [], 0, 0
    for end in sorted(ends[0].keys() & ends[1].keys()):
        p, q = ends[0][end], ends[1][end]
        groups.append((x[i:p + 1], y[j:q + 1]))
        links.append((x[p], y[q]))
        i, j = p + 1, q + 1
    return groups, links


def rows_of(texts, sides):
    """The contract's columns of every text, counted over all of them."""
    found = [(both := sides(t)) and (both, *brute(both)) for t in texts]
    n = Counter(pair for f in found if f for pair in f[2])
    most = {}
    for (_, b), k in n.items():
        most[b] = max(most.get(b, 0), k)
    out = []
    for f in found:
        if not f:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        both, groups, links = f
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((len(both[0]), len(both[2]), len(groups), len(links), sum(n[p] == most[p[1]] for p in links), sum(n[p] for p in links), sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_awkward_rows(spark, sides):
    texts = [*ODD, ODD[9], "a b c"]
    df = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df = df.select("*", *(F.lit("x").alias(c) for c in ("block", "pair", "pairs", "ns", "value", "known", "ids", "n_a", "b"))).repartition(3)
    want = Counter((i if i != 3 else None, *r) for i, r in enumerate(rows_of(texts, sides)))
    got = Counter(tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in alignment.alignment_summary(df, A_PATH, B_PATH).collect())
    assert got == want
    assert sum(r[-1] == "" for r in want) < len(texts) // 2
    groups = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in alignment.align_documents(df, A_PATH, B_PATH).collect() if r.doc_id is not None}
    for i, t in enumerate(texts):
        if i != 3:
            assert groups[i] == ((both := sides(t)) and brute(both)[0] or [])
    assert alignment.alignment_summary(df.limit(0), A_PATH, B_PATH).collect() == []
    no_tokens = df.filter("doc_id < 2")
    assert [r.n_links for r in alignment.alignment_summary(no_tokens, A_PATH, B_PATH).collect()] == [0, 0]


def test_small_blocks_and_short_memory(spark, sides, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text").collect()
    texts = [r.text for r in docs]
    aligner = alignment.Aligner(alignment.Sides(open(A_PATH, "rb").read(), open(B_PATH, "rb").read()))
    monkeypatch.setattr(alignment, "KNOWN", 50)
    monkeypatch.setattr(alignment, "_TEXTS", 3)
    monkeypatch.setattr(alignment, "LONGEST", 6)
    for t, found in zip(texts, aligner.aligned(texts), strict=True):
        both = sides(t)
        assert ";".join(w[3] for w in found or ()) == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in (brute(both)[0] if both else ()))


def test_a_word_is_aligned_and_remembered_once(sides, monkeypatch):
    both = alignment.Sides(open(A_PATH, "rb").read(), open(B_PATH, "rb").read())
    texts = [" ".join(f"Wort{i}ä,{i * i}" for i in range(k, k + 20)) for k in (0, 10, 0, 20, 10, 30)]
    aligner = alignment.Aligner(both)
    list(aligner.aligned(texts))
    assert sum(len(x) for x in vars(aligner).values() if isinstance(x, dict)) == 50  # nothing is kept by ids beside the words
    aligner = alignment.Aligner(both)
    monkeypatch.setattr(alignment, "KNOWN", 40)
    monkeypatch.setattr(alignment, "_TEXTS", 2)
    learnt, learn = [], aligner._learn
    monkeypatch.setattr(aligner, "_learn", lambda new, into: (learnt.extend(new), learn(new, into)))
    for t, found in zip(texts, aligner.aligned(texts), strict=True):
        assert ";".join(w[3] for w in found) == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in brute(sides(t))[0])
    assert len(learnt) == len(set(learnt)) == 50  # also those that come back from the older generation


def test_long_texts_are_taken_few_at_a_time(sides, monkeypatch):
    """The words of all texts taken at a time are held, and the new ones remembered."""
    aligner = alignment.Aligner(alignment.Sides(open(A_PATH, "rb").read(), open(B_PATH, "rb").read()))
    texts = [f"{'long text here ' * 40_000}{i}" for i in range(6)] + [None, "", "short one", "x" * 5]
    taken, some = [], aligner._aligned
    monkeypatch.setattr(aligner, "_aligned", lambda ts: (taken.append(len(ts)), some(ts))[1])
    got = [found and (sum(w[0] for w in found), ";".join(w[3] for w in found)) for found in aligner.aligned(texts)]
    assert taken == [1, 1, 1, 1, 1, 5]
    for t, found in zip(texts, got, strict=True):
        both = sides(t)
        assert found == (both and (len(both[0]), ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in brute(both)[0])))
    assert list(aligner.aligned([])) == []


def test_blocks_are_bounded_rows_in_bounded_files(spark, monkeypatch):
    """Spark holds many rows of a file at a time: long blocks, or many in a file, fill an executor's heap on large tables."""
    words = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it"]
    text = " ".join(words[i * i % 10] for i in range(20_000))
    df = spark.createDataFrame([(i, text if i < 30 else None) for i in range(4030)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(alignment, "ROWS", 2)
    blocks = alignment._blocks(df, A_PATH, B_PATH, "doc_id", "text")
    files = blocks.groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) <= 2
    found = blocks.select(F.expr("aggregate(n_links, 0L, (x, y) -> x + y)").alias("links"), F.size("ids").alias("docs"), F.length("places").alias("size")).collect()
    assert sum(r.docs for r in found) == 4030 and max(r.docs for r in found) <= 2000  # texts without tokens end a block too
    assert sum(r.links for r in found) == 30 * 20_000 and max(r.size for r in found) < 300_000
    got = alignment.alignment_summary(df, A_PATH, B_PATH).collect()
    assert sorted(r.doc_id for r in got) == list(range(4030)) and {r.n_links for r in got} == {20_000, 0}
    assert len({(r.n_best, r.count_sum) for r in got if r.n_links}) == 1


def test_places_among_many_pairs():
    assert [alignment._kind(n) for n in (1, 1 << 16, (1 << 16) + 1)] == ["<u2", "<u2", "<i4"]


def test_whole_table_against_brute_force(spark, sides):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, *x) for r, x in zip(docs, rows_of([r.text for r in docs], sides), strict=True)}
    got = queries.QUERIES["op12_tokenizer_alignment"](spark, SF).collect()
    assert {tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in got} == want
    counts = alignment.link_counts(spark.read.parquet(f"{SF}/documents.parquet"), A_PATH, B_PATH)
    assert counts.agg(F.sum("n")).first()[0] == sum(r[4] for r in want)
