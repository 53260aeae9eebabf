"""Each operator on awkward rows, and against brute force on whole tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tunetable.llm import bpe_stream, components, exact_dedup, html_text, licenses, line_dedup, mixing, near_dup, passages, quality, queries, toxicity

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(6000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS = [
    (1, "A line of some length\nother text here to keep", "a", "en"),
    (2, "a LINE of some length \nown words only in here", "a", "en"),
    (3, "A line of some length\nother  text here to keep", "b", None),
    (4, None, None, "en"),
    (5, "", None, "en"),
    (6, " \t\n", "b", "en"),
    (7, LONG, "c", "de"),
    (8, LONG + " end", "c", "de"),
    (8, LONG + " end", "c", "de"),
    (9, f"before one {PASSAGE} after one", "a", "en"),
    (10, f"quite another start {PASSAGE.upper()} and end", "a", "en"),
    (None, "A line of some length\nother text here to keep", "c", "en"),
    (None, None, "c", "en"),
    (11, "Ther " * 500, "a", "en"),
    (12, "Released under the MIT License.", "z", "en"),
]
CLASH = ["norm", "key", "mark", "row", "node", "size", "cell", "late", "pos", "score", "sha", "component", "path", "kept", "html"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def _words(t):
    return (t or "").encode().lower().split()


def test_line_dedup(odd, empty):
    out = line_dedup.keep_bitmaps(odd, with_text=True).select("*", line_dedup.kept_lines("text", "keep_bitmap").alias("left")).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[1].n_dropped == 0 and by[2].left == "own words only in here"
    assert by[3].left == "other  text here to keep" and by[3].n_dropped == 1
    assert by[4].n_lines == 1 and by[4].left == "" and by[6].n_lines == 2
    assert [r.n_dropped for r in out if r.doc_id == 8] == [0, 0]
    assert sorted(r.left for r in out if r.doc_id is None) == ["", ""]
    assert line_dedup.keep_bitmaps(empty).count() == 0


def test_line_dedup_across_ranges(spark):
    """A key whose rows fill several ranges keeps its first document only."""
    df = spark.range(3000).select((F.col("id") + 5).alias("doc_id"), F.lit("the very same line\nshort").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = line_dedup.keep_bitmaps(df).groupBy("n_dropped").agg(F.count("*").alias("n"), F.min("doc_id").alias("d")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.n_dropped, r.n, r.d) for r in out} == {(0, 1, 5), (1, 2999, 6)}


@pytest.mark.parametrize("bits,capacity", [(64, 1 << 15), (2, 2)])
def test_exact_dedup(odd, empty, bits, capacity):
    out = exact_dedup.exact_groups(odd, capacity=capacity, bits=bits).collect()
    assert len(out) == len(ROWS)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in ROWS]
    size, keep = Counter(norm), defaultdict(list)
    for (i, *_), n in zip(ROWS, norm):
        keep[hashlib.sha256(n.encode()).hexdigest()].append(i)
    for r in out:
        ids = [i for i in keep[r.text_sha256] if i is not None]
        assert r.keep_id == min(ids, default=None) and r.group_size == len(keep[r.text_sha256])
    assert sum(r.kept for r in out) == len(size)
    assert exact_dedup.drop_copies(odd, bits=bits, capacity=capacity).count() == len(size)
    assert exact_dedup.drop_copies(odd).columns == odd.columns
    assert exact_dedup.exact_groups(empty).count() == 0


def test_html():
    page = """<html><head><title>No</title></head><body class="has-sidebar"><nav><a href=x>Home</a></nav><!-- <p>no</p> -->
    <div class="cookie-notice">We use cookies</div><article class="post"><header><h1>Head&amp;line</h1></header><p>One <b>bold</b>er<br>two&nbsp;&lt;3 <p>three
    <script>var a = "</p><p>no";</script> four <div class="comments"><p>Nice!</p></div></article><aside>no</aside><footer>&copy; no</footer></body></html>"""
    assert html_text.main_text(page) == "Head&line One bolder two\xa0<3 three four"
    plain = "<div><a href=a>Link one</a> <a href=b>two</a></div><p>Short first.</p><p>The fox of the wood was in a house that is for the king and the queen of all.</p><p>Short last.</p><form>no</form>"
    assert html_text.main_text(plain).startswith("Short first. The fox") and html_text.main_text(plain).endswith("Short last.")
    for broken in (None, "", "<", "<p", "<script>x", "<!--", "</div></p>", "<a href='x" * 2000, "<div>" * 3000):
        assert isinstance(html_text.main_text(broken), str)
    assert html_text.main_text("no tags  at all") == "no tags at all"


@pytest.mark.parametrize("start, end", [
    ('<div class="page has-sidebar">', "</div>"), ('<div class="layout with-comments">', "</div>"), ("<form action=x method=post>", "</form>"),
    ('<div class="sidebar">', "</div>"), ("<a name=top>", ""), ("<p><a href=x>open link</p>", ""), ("<div id=no-js>", "</div>")])
def test_html_wrapped_pages(start, end):
    body = "The fox of the wood was in a house that is for the king and the queen of all the land."
    rest = '<div class="comments"><p>The first of the comments is not what we are here for, and it is on the page.</p></div><footer>no</footer>'
    page = f"<html><body>{start}<nav><a href=a>Home</a></nav>{{}}{rest}{end}</body></html>"
    assert html_text.main_text(page.format(f"<article><h1>Title</h1><p>{body}</p></article>")).endswith(f"Title {body}")
    assert body in html_text.main_text(page.format(f"<p>{body}</p><p>{body} Again.</p>"))
    assert "comments" not in html_text.main_text(page.format(f"<article><h1>Title</h1><p>{body}</p></article>"))


def test_html_parts_stay_out():
    body = "The fox of the wood was in a house that is for the king and the queen of all the land."
    page = f'<article><h2>Rights</h2><section id="copyright"><p>{body}</p></section><div class="copyright">(c) no</div></article><div class="comments"><p>{body * 9}</p></div>'
    assert html_text.main_text(page) == f"Rights {body}"  # a long part named for comments isn't the page while there is an article
    cards = "<ul><li><a href=x><div>One card of links</div></a></li><li><a href=y><div>Another card</div></a></li></ul>"
    assert html_text.main_text(f"{cards}<p>{body}</p>") == body  # closed links around blocks are links


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "t"), (None, None, None, "t")], "page_id long, url string, html string, text string")
    assert {(r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()} == {(1, "x", 1), (None, "", 0)}
    assert html_text.extract(df.limit(0)).count() == 0


def test_passages(odd, empty):
    out = passages.passages(odd).collect()
    assert {r.doc_id for r in out} == {7, 8, 9, 10}
    by = {r.doc_id: r for r in out}
    assert (by[9].start_word, by[9].n_words, by[9].other_doc_id, by[9].later) == (2, 60, 10, False)
    assert (by[10].start_word, by[10].n_words, by[10].later) == (3, 60, True)
    assert by[7].n_words == by[8].n_words == 6000
    assert passages.passages(empty).count() == 0


def test_passages_against_brute_force(docs):
    texts = {r.doc_id: _words(r.text) for r in docs.select("doc_id", "text").collect()}
    holders = defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - passages.LEAST + 1):
            holders[tuple(w[k:k + passages.LEAST])].add(i)
    expected = defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - passages.LEAST + 1):
            if len(holders[tuple(w[k:k + passages.LEAST])]) > 1:
                expected[i] |= set(range(k, k + passages.LEAST))
    found = defaultdict(set)
    for r in passages.passages(docs).collect():
        found[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert found == expected


def test_passages_around_common_wording(spark):
    """45 common words in 600 documents; 60 pairs of these share the 20 words before them too."""
    common = " ".join(f"c{k}" for k in range(45))

    def text(i):
        before = f"pair{i % 60}x" if i < 120 else f"own{i}x"
        return " ".join([f"start{i}", *(f"{before}{k}" for k in range(20)), common, *(f"end{i}x{k}" for k in range(40))])

    out = passages.passages(spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.other_doc_id, r.later) for r in out) == [(i, 1, 66, (i + 60) % 120, i >= 60) for i in range(120)]


def test_quality_counts():
    c = quality.count("a b c d e f\na b c d e g\n\na b c d e g")
    assert (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words) == (18, 18, 0, 1, 17)
    assert quality.count("").failed and quality.count("#*$ |").n_symbols == 4
    ws = "x y z x y z x y z q".split()
    brute = [any(Counter(tuple(ws[k:k + 5]) for k in range(6))[tuple(ws[k:k + 5])] > 1 and k <= i < k + 5 for k in range(6)) for i in range(10)]
    assert quality.repeated(ws).tolist() == brute


def test_quality_labels(spark, odd, empty):
    train = [("\n".join(["This is a sentence of the text, and it goes on."] * 1 + [f"The next line {i} is in the house."] * 1), 1) for i in range(30)]
    train += [("\n".join(f"{i} | buy### {k} | $$$" for k in range(6)), 0) for i in range(30)]
    chain = quality.fit(train)
    assert chain.content_share(train[0][0]) > 0.5 > chain.content_share(train[-1][0])
    assert chain.content_share("") == 0
    out = quality.judge(odd, chain).collect()
    assert len(out) == len(ROWS) and all(r.base_failed and not r.kept for r in out if r.n_words < 10)
    assert quality.judge(empty, quality.Chain()).count() == 0


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    c = quality.Chain(rng.normal(size=quality.FEATURES), rng.normal(size=(2, 2)), rng.normal(size=2))
    x = rng.integers(0, 2, size=(7, quality.FEATURES)).astype(float)

    def value(path):
        e = x @ c.emit
        return c.first[path[0]] + sum(e[i] for i, s in enumerate(path) if s) + sum(c.step[a, b] for a, b in zip(path, path[1:]))

    assert c.viterbi(x) == list(max(itertools.product((0, 1), repeat=7), key=value))


def test_near_dup(odd, empty):
    out = near_dup.near_groups(odd).collect()
    assert len(out) == len(ROWS)
    comp = {r.doc_id: r.component_id for r in out if r.doc_id is not None}
    assert comp[1] == comp[3] == 1 and comp[7] == comp[8] == 7 and comp[4] == 4 and comp[5] == 5 and comp[9] == 9
    nulls = sorted((r.component_id is None, r.kept) for r in out if r.doc_id is None)
    assert nulls == [(False, False), (True, True)]
    assert near_dup.drop_near_copies(odd).columns == odd.columns
    assert near_dup.near_groups(empty).count() == 0


def test_near_dup_keeps_one_of_repeated_rows_without_id(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), "quite other words in here that no one else has"
    rows = [(None, a), (None, a), (None, b), (None, None), (None, None), (None, " "), (None, a + " end"), (3, b), (3, b), (4, b + " .")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("any"), F.lit("y").alias("mark"), F.lit(1).alias("n")).repartition(3)
    got = near_dup.drop_near_copies(df)
    assert got.columns == df.columns
    texts = Counter((r.doc_id, r.text) for r in got.collect())
    assert sum(n for (_, t), n in texts.items() if t and t.startswith("w0")) == 1
    assert texts[3, b] == 2 and texts[None, b] == 0 and texts[None, None] == 2 and texts[None, " "] == 1


def test_near_dup_against_brute_force(docs):
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = _words(r.text)
        sets[r.doc_id] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    out = near_dup.near_groups(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_near_dup_in_a_crowd_of_one_template(spark):
    """1,200 documents of one template, below the threshold but for 150 pairs (0.758) among them."""
    def text(i):
        if i >= 300:
            return " ".join([f"t{k}" for k in range(164)] + [f"own{i}x{k}" for k in range(36)])
        return " ".join([f"t{k}" for k in range(164)] + [f"pair{i // 2}x{k}" for k in range(9)] + [f"own{i}x{k}" for k in range(27)])

    out = near_dup.near_groups(spark.createDataFrame([(i, text(i)) for i in range(1200)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: i - i % 2 if i < 300 else i for i in range(1200)}


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (7, 7)] + [(500, k) for k in range(501, 560)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(out[i] == 1 for i in range(1, 41)) and out[300] == 100 and all(out[k] == 500 for k in range(500, 560))


def test_mixing(odd, empty):
    out = mixing.mixture(odd).collect()
    assert len(out) == len(ROWS) and all(r.taken <= 2 * r["size"] for r in out)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mixture(odd).collect()), key=str)
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mixture(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixing_of_equal_sizes(spark):
    """One source, target 1.5 times its size: the half is met exactly, also where it ends with a cell."""
    for n in (2, 20, 400):
        out = mixing.mixture(spark.createDataFrame([(i, f"a b c d e{i}", "a") for i in range(n)], "doc_id long, text string, source string")).collect()
        assert sum(r.taken for r in out) == 7.5 * n and sorted(r.epochs for r in out) == [1] * (n // 2) + [2] * (n // 2)


def test_mixing_against_brute_force(docs):
    out = mixing.mixture(docs).collect()
    size, words = defaultdict(int), {r.doc_id: len(_words(r.text)) for r in docs.collect()}
    for r in out:
        assert r["size"] == words[r.doc_id]
        size[r.source] += r["size"]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(size))}
    left, target, open_ = 1.5 * sum(size.values()), dict.fromkeys(size, 0.0), set(size)
    while open_ and left > 1e-6:
        total, share = sum(weight[s] for s in open_), left
        for s in sorted(open_):
            target[s] += share * weight[s] / total
        left = sum(max(0, target[s] - 2 * size[s]) for s in size)
        target = {s: min(t, 2 * size[s]) for s, t in target.items()}
        open_ = {s for s in open_ if target[s] < 2 * size[s]}
    by = defaultdict(list)
    for r in out:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        by[r.source].append(r)
    for s, rows in by.items():
        taken = sum(r.taken for r in rows)
        assert abs(taken - target[s]) <= max(r["size"] for r in rows) / 2 + 1
        whole = int(target[s] // size[s])
        assert {r.epochs for r in rows} <= {whole, whole + 1}


def test_bpe_against_the_library(docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    out = {r.doc_id: r for r in bpe_stream.token_digests(docs, path).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        o = out[r.doc_id]
        assert o.n_tokens == len(ids) and o.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert o.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_words_are_spelled_from_remembered_pieces():
    """A word is remembered once, and one with other characters beside its letters is put together from what is known."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, e = Tokenizer.from_file(path), bpe_stream.Encoder(bpe_stream.MergeTable(open(path, "rb").read()))
    calls, merge = [], e.table.merge
    e.table.merge = lambda data: calls.append(data) or merge(data)
    for text in ("thingness, thingness. thingness", "thingness.\nThingness it's 12,5 x,, a.b ., , don't,", "Ünïcödé, 数据. ٣, \u0301a. ß.", ", a", "a  b, c ", "x" * 5000 + ". end,"):
        n, ids, data = zip(*e.spell(text), strict=True)
        want = library.encode(text, add_special_tokens=False).ids
        assert sum(n) == len(want) and ",".join(ids) == ",".join(map(str, want)) and b"".join(data).decode() == text
    assert calls.count(b" thingness") == 1 and not any(len(p) > 1 and p.strip().isalpha() for p in e.known if p[0] == " ")


def test_bpe_streams():
    import random

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    table = bpe_stream.MergeTable(open(path, "rb").read())
    library, encoder, rng = Tokenizer.from_file(path), bpe_stream.Encoder(table), random.Random(8)
    parts = ["th", "er", " ", "  ", "\n", "é", "ß", "'s", "<|endoftext|>", "0", "漢", "😀", "\x1c", "\x85", "aaaa", "=-", "<|endo"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(400)]
    texts += ["ab" * 5000, " " * 6000, "é" * 3000, "=" * 5000, "".join(rng.choices(["th", "er", "zq", "ing"], k=4000))]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t) == ids
        k = rng.randint(1, 700)
        assert list(encoder.encode_parts(t[i:i + k] for i in range(0, len(t), k))) == ids
        d = bpe_stream.Decoder(table)
        assert "".join(d.feed([i]) for i in ids) + d.feed([], True) == t
    faulty = [encoder.encode("é")[0], encoder.encode("😀")[0]][:1] + encoder.encode("a")
    assert bpe_stream.Decoder(table).feed(table.merge(b"\xc3") + table.merge(b"a"), True) == library.decode(table.merge(b"\xc3") + table.merge(b"a"), skip_special_tokens=False)
    assert faulty
    piece = "".join(rng.choices(["th", "er", "zq", "ing", "é"], k=3000)).encode()
    t = bpe_stream.Transducer(table)
    assert [*t.feed(piece), *t.finish()] == table.merge(piece) and len(t.held) == 0


def test_bpe_rows(odd, empty):
    path = queries.tokenizer_path()
    back = bpe_stream.decode_documents(bpe_stream.encode_documents(odd, path), path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t, *_ in ROWS)
    assert bpe_stream.token_digests(empty, path).count() == 0


def test_licenses(odd, empty, spark):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    out = {(r.doc_id, r.path): r for r in licenses.scan(odd, path, keep=("doc_id",)).collect()}
    mine = next(r for r in out.values() if r.doc_id == 12)
    assert mine.own_license == "MIT" and mine.is_license_file
    files = [("LICENSE", "Licensed under the Apache License, Version 2.0."), ("src/a.c", "int x;"), ("src/gpl/COPYING", "text\nThis work is licensed under the GNU General Public License, version 3.\nmore\nand more of it"),
             ("src/gpl/deep/b.c", None), ("src/gplx/c.c", ""), ("src/gpl/own.c", "Released under the MIT License.\nint main() { return 0; }\nint more;"), (None, "x")]
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame(files, "p string, text string"), F.col("p")).collect()}
    assert got == {"LICENSE": "Apache-2.0", "src/a.c": "Apache-2.0", "src/gpl/COPYING": "GPL-3.0", "src/gpl/deep/b.c": "GPL-3.0", "src/gplx/c.c": "Apache-2.0", "src/gpl/own.c": "MIT", None: None}
    assert licenses.scan(empty, path).count() == 0


def test_toxicity(spark, odd, empty):
    import random

    rng = random.Random(1)
    plain = [" ".join(rng.choices([a + b for a in ("th", "er", "on", "in") for b in ("at", "ing", "ou", "es")], k=60)) for _ in range(160)]
    bad = [" ".join(w if rng.random() > 0.06 else rng.choice(["vileword", "nastyterm", "uglyphrase"]) for w in t.split()) for t in plain[:60]]
    model = toxicity.fit([(t, 0) for t in plain[60:140]] + [(t, 1) for t in bad[:50]], 0.4)
    tools = model.compressors()
    rate = [model.score(model.evidence(t, tools)) for t in bad[50:] + plain[140:]]
    assert sum(s >= 0.5 for s in rate[:10]) >= 9 and sum(s >= 0.5 for s in rate[10:]) <= 1
    out = toxicity.score(odd, model, out="score").collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit([], 0.25).score([]) == 0.25
    assert toxicity.train(odd, _labels(spark).limit(0)).prior == 0


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = queries.op10_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").select("doc_id", "predicted", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out) and docs.count() == 10000
    assert sum(r.predicted == r.toxic for r in out) / len(out) > 0.95
    assert sum(r.predicted > r.toxic for r in out) / sum(r.toxic == 0 for r in out) < 0.02
