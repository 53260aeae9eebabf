"""BPE (F2): the encoder and its form as joins against the published `tokenizers`
implementation, on a small vocabulary with special tokens and on a public one
with word ends; round trips; the Spark UDF."""

import json

import pytest

from tunetable.functions.bpe import bpe_decode, bpe_encode, load_tokenizer, parse_tokenizer
from tunetable.functions.bpe_tables import check_merges, encode_words, pieces, token_usage
from tunetable.resources import default_tokenizer_path
from tunetable.sources.vocab import read_vocab

from tokenizer_spec import MERGES, build_tokenizer_spec

SAMPLES = ["call me ishmael.", "the cat sat on the mat", "hello,  world!! (ok) -- yes; no: maybe?",
           "digits 123 and é accents", "", " lead and trail ", "x[unk]y", "a_b c'd", "tion-ation ing"]


def test_matches_tokenizers_library():
    tokenizers = pytest.importorskip("tokenizers")
    spec = build_tokenizer_spec()
    ref = tokenizers.Tokenizer.from_str(json.dumps(spec))
    ours = parse_tokenizer(spec)
    for s in SAMPLES:
        expect = ref.encode(s.replace(" ", "[SPACE]")).ids
        assert ours.encode(s) == expect, s


def test_small_vocab_hand_case():
    spec = build_tokenizer_spec("abc", ["a b", "ab c"])
    m = parse_tokenizer(spec)
    # ids: specials 0-2, a=3 b=4 c=5, ab=6, abc=7
    assert m.encode("abc ab cab x") == [7, 2, 6, 2, 5, 6, 2, 1]
    assert m.encode("7") == [1]
    assert m.decode(m.encode("abc ab")) == "abc ab"


def test_roundtrip_in_vocabulary():
    m = parse_tokenizer(build_tokenizer_spec())
    for s in ["call me ishmael.", "the end; of it: all (really)?", "a - b / c"]:
        assert m.decode(m.encode(s)) == s


@pytest.fixture(scope="module")
def small():
    return parse_tokenizer(build_tokenizer_spec())


@pytest.fixture(scope="module")
def public():
    return load_tokenizer(default_tokenizer_path())


@pytest.mark.parametrize("which", ["small", "public"])
def test_udf_matches_python(spark, request, which):
    tok = request.getfixturevalue(which)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)] + [(99, None)], "i int, s string")
    out = df.select("i", bpe_encode("s", tok).alias("ids")).withColumn("back", bpe_decode("ids", tok)).collect()
    for r in out:
        if r["i"] == 99:
            assert r["ids"] is None and r["back"] is None
        else:
            assert r["ids"] == tok.encode(SAMPLES[r["i"]])
            assert r["back"] == tok.decode(tok.encode(SAMPLES[r["i"]]))


PUBLIC = [*SAMPLES, "don't we'll  it's", "éte größe наука 日本語", "a1b22 c", "x" * 300, "ab" * 500, "..!! ((", "\u00a0wide\u3000space", "é é", "🙂 ok", " "]


def test_public_file_matches_the_library(public):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(default_tokenizer_path())
    for s in PUBLIC:
        assert public.encode(s.lower()) == ref.encode(s.lower(), add_special_tokens=False).ids, s
        assert bytes(public.encode_bytes(s.lower(), {})) == b"".join(i.to_bytes(4, "little") for i in public.encode(s.lower()))
    assert public.decode(public.encode("don't stop, größe")) == "don 't stop , größe"


def test_read_vocab(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps(build_tokenizer_spec()))
    vocab, merges = read_vocab(spark, str(path))
    v = {r["token"]: r["id"] for r in vocab.collect()}
    assert v["[STOP]"] == 0 and v["[UNK]"] == 1 and v["[SPACE]"] == 2
    m = merges.orderBy("rank").collect()
    assert (m[0]["left"], m[0]["right"]) == tuple(MERGES[0].split(" "))
    assert len(m) == len(MERGES)
    vocab, merges = read_vocab(spark)
    assert merges.count() == 48894 and vocab.filter("token = 'the</w>'").count() == 1


def test_joins_match_the_library(spark, public):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(default_tokenizer_path())
    vocab, merges = read_vocab(spark)
    docs = spark.createDataFrame([(s.lower(),) for s in PUBLIC] + [(None,), ("",)], "text string")
    words = docs.selectExpr("text").select(pieces(docs["text"], public).alias("p")).selectExpr("explode(p) AS word")
    got = {r.word: r.ids for r in encode_words(words, public, vocab, merges).collect()}
    assert set(got) == {w for s in PUBLIC for w in public._pieces.findall(s.lower())}
    for w, ids in got.items():
        assert ids == ref.encode(w, add_special_tokens=False).ids == public.encode(w), w
    usage = {r.id: r.n for r in token_usage(docs, "text", public, vocab, merges).collect()}
    want = {}
    for s in PUBLIC:
        for i in ref.encode(s.lower(), add_special_tokens=False).ids:
            want[i] = want.get(i, 0) + 1
    assert usage == want


def test_joins_with_unknown_characters_and_marks(spark, tmp_path, small):
    path = tmp_path / "t.json"
    path.write_text(json.dumps(build_tokenizer_spec()))
    vocab, merges = read_vocab(spark, str(path))
    words = ["the", "thethe", "tionation", "7x7", "a", "\ufdd0a\ufdd1", "aaa", "ishmael", "an" * 50]
    got = {r.word: r.ids for r in encode_words(spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "word string"), small, vocab, merges).collect()}
    assert got == {w: small._merge_word(w) for w in words}
    assert encode_words(spark.createDataFrame([], "word string"), small, vocab, merges).collect() == []


def test_merges_that_have_no_rank_order_raise(spark):
    table = lambda ms: spark.createDataFrame([(i, *m.split(" ")) for i, m in enumerate(ms)], "rank int, left string, right string")
    assert check_merges(table(["a b", "ab c"])) == 3
    for bad in (["ab c", "a b"], ["a b", "ab c", "b c", "a bc"]):
        with pytest.raises(ValueError):
            check_merges(table(bad))


def test_encoding_holds_a_bounded_part(spark):
    """Long segments aren't remembered, a batch is encoded in parts, and the ids are those of the whole texts."""
    import numpy as np
    import pyarrow as pa

    from tunetable.functions import bpe
    from tunetable.resources import default_tokenizer_path
    tok = load_tokenizer(default_tokenizer_path())
    cache = {}
    tok.encode_bytes("some words " + "long" * 500, cache)
    tok.encode("some words " + "long" * 500, kept := {})
    assert max(len(k) for k in [*cache, *kept] if k) < 100
    texts = [None, "", "some words", "word " * 300_000, "x" * 3000, None, *(f"text {i} " * 2000 for i in range(150))]
    parts = list(bpe._parts(pa.array(texts)))
    assert [t for p in parts for t in p.to_pylist()] == texts and len(parts) > 2
    assert all(p.nbytes < 2 * bpe._PART for p in parts) and list(bpe._parts(pa.array([], pa.string()))) == []
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(2)
    out = {r.i: r.ids for r in df.select("i", bpe_encode("s", tok).alias("ids")).collect()}
    assert all(out[i] == tok.encode(t) if t is None or len(t) < 4000 else np.array_equal(out[i], tok.encode(t)) for i, t in enumerate(texts))
