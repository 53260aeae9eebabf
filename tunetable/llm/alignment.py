"""Alignment of two tokenizers' tokens over the same bytes, through whitespace-token anchors.

A is a byte-level BPE file run on a blank and the text, B a piece model run on
the text, before which it puts a blank itself. Both tokenise the whole text. A
place where both have a space-marked token next, and where the bytes of the
tokens before it are equal (verified), is an anchor: it is a shared end. Anchors
split a document into token-id windows, mostly a word long. The byte offsets at
which both sides end a token cut a window into groups, and the tokens that end
there are linked.

Tokenising a word between two anchors does not depend on its neighbours (a
blank before a non-blank starts a piece for A, and no piece of B holds a blank
behind another character, which ``Sides`` checks), so a word's window and its
alignment are remembered by the word; words that a batch brings anew are
tokenised together, as one text, and their windows are aligned together.

How often an id pair is linked is counted over all documents. Documents are
handled in blocks of some ``LINKS`` links. A block is one stored row: its
distinct pairs with their numbers, and each document's links as places among
these pairs, compressed. Only distinct pairs of blocks are exploded, summed and
joined with the totals; they meet their block again by its number. A frequent
pair is combined before the shuffle and comes back once a block, not once a
link. Spark's Parquet writer and reader hold many rows at a time, whatever
their size, so a stored file has ``ROWS`` blocks at most.

Defined cases: a text that is null or empty, or whose joined A or B bytes
differ from the blank and the text, has no tokens: zeros and the empty string
for its digest. Strings of special tokens inside a text are plain text.
Repeated rows count each on its own; null ids stay; other columns are not
read; an empty table gives an empty table. A text may be of any length; a
document that exceeds a block makes a block of its own.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_stream import byte_symbols
from .common import ready, stored

#: The published pattern of byte-level BPE pieces (a fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Links from which on a block ends, links that a document's other columns count as, and blocks in a stored file.
LINKS, DOCUMENT, ROWS = 1 << 17, 100, 32
#: Words that a worker remembers in each of two generations, and the longest such word.
KNOWN, LONGEST = 100_000, 48
#: Texts that are split into words, the characters that end them earlier, and new words that are tokenised, at a time.
_TEXTS, _CHARS, _NEW = 300, 1 << 20, 2000
_MARK = "▁"
_ID = 1 << 20


class Sides:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, byte_bpe: bytes, pieces: bytes) -> None:
        import sentencepiece
        import tiktoken

        spec = json.loads(byte_bpe)
        back = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.model = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        b_bytes = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(names)]
        if any(_MARK in p.lstrip(_MARK) for p in names):
            raise ValueError("a piece with a blank behind another character: words can't be tokenised apart")
        by_id = {i: t for t, i in ranks.items()}
        #: Of each id: its bytes (none where no token has it), their length, and whether it is space-marked.
        self.tokens, self.lengths, self.marked = [], [], []
        for table in ([by_id.get(i, b"") for i in range(max(by_id) + 1)], b_bytes):
            self.tokens.append(pa.array(table, pa.large_binary()))
            self.lengths.append(np.array(list(map(len, table)), dtype=np.int64))
            self.marked.append(np.array([t[:1] == b" " for t in table]))

    def b(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def both(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a blank and the text on both sides, None if either side's bytes differ from it."""
        sides, data = [np.array(x, dtype=np.int32) for x in (self.a(" " + text), self.b(text))], pa.py_buffer(b" " + text.encode("utf-8", "surrogatepass"))
        for ids, tokens, lengths in zip(sides, self.tokens, self.lengths, strict=True):
            n = int(lengths[ids].sum())
            if n != data.size or not tokens.take(pa.array(ids)).buffers()[2].slice(0, n).equals(data):
                return None
        return tuple(sides)


class Aligner:
    """Windows of whole texts and their alignments."""

    def __init__(self, sides: Sides) -> None:
        import regex

        self.sides = sides
        n_a, n_b = map(len, sides.lengths)
        #: A's ids with the comma inside a group and the bar at its end, B's with the comma, the semicolon and nothing at a window's end.
        self.written = pa.array([f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, (",", ";", ""))) for mark in marks for i in range(n)], pa.large_string())
        self.odd = regex.compile(r" (?=\s|\Z)")
        self.border = regex.compile(r"(?<! ) (?=\S)")
        #: Words' alignments in two generations: when the newer one is full it becomes the older, from which what is still in use comes back.
        self.words: dict = {}
        self.older: dict = {}

    def split(self, text: str) -> list[str]:
        """The words of a blank and the text, without the blank that starts each; a word may hold white space that is no anchor."""
        if not self.odd.search(text) and not text[0].isspace():
            return text.split(" ")
        head, *tail = self.border.split(" " + text)
        return [head[1:], *tail] if head else tail

    def _learn(self, new: list[str], into: dict) -> None:
        """The windows of words without a blank and with no white space in front, or of one word: tokenised as one text
        and taken apart before space-marked tokens; a word whose ends can't be verified is tried alone, and has no window if that fails too."""
        both = self.sides.both(" ".join(new))
        if both:
            at = [np.flatnonzero(mark[x]) for x, mark in zip(both, self.sides.marked, strict=True)] if len(new) > 1 else [np.zeros(1, dtype=np.int64)] * 2
            if len(at[0]) == len(at[1]) == len(new):
                into.update(zip(new, self.align(both, at), strict=True))
                return
        if len(new) > 1:
            half = len(new) // 2
            self._learn(new[:half], into)
            self._learn(new[half:], into)
            return
        into[new[0]] = ()

    def align(self, both: tuple[np.ndarray, np.ndarray], at: list[np.ndarray]) -> list[tuple[int, int, int, str, bytes]]:
        """``(n_a, n_b, n_groups, groups, links)`` of the windows that start at the places ``at`` of both sides; links as A id * 2^20 + B id.

        Both sides of every window have the same bytes, so offsets are equal at
        its end, and the windows are aligned as one stream.
        """
        a, b = both
        ends = [np.cumsum(n[x]) for x, n in zip(both, self.sides.lengths, strict=True)]
        shared = []
        for x, y in (ends, ends[::-1]):
            here = np.zeros(y[-1] + 1, dtype=bool)
            here[y] = True
            shared.append(here[x])
        i, j = map(np.flatnonzero, shared)
        links = (a[i].astype(np.int64) * _ID + b[j]).tobytes()
        # a group's tokens of A are written behind B's of the groups before it, and B's behind A's of the same group
        group = [np.cumsum(x) - x for x in shared]
        n_a, n_b = map(len, self.sides.lengths)
        lasts = np.r_[at[1][1:], len(b)] - 1
        kind_b = shared[1].astype(np.int64)
        kind_b[lasts] = 2
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + np.r_[0, j + 1][group[0]]] = a + n_a * shared[0].astype(np.int64)
        order[np.arange(len(b)) + (i + 1)[group[1]]] = 2 * n_a + b + n_b * kind_b
        _, places, data = self.written.take(pa.array(order)).buffers()
        places = np.frombuffer(places, dtype=np.int64, count=len(order) + 1)
        text = data.slice(0, int(places[-1])).to_pybytes().decode("ascii")
        starts = [np.r_[x, len(ids)] for x, ids in zip(at, both, strict=True)]
        n = [np.diff(x).tolist() for x in starts]
        cut, first = places[starts[0] + starts[1]].tolist(), [*group[0][at[0]].tolist(), len(i)]
        return [(p, q, y - x, text[s:e], links[8 * x:8 * y]) for p, q, x, y, s, e in zip(*n, first, first[1:], cut, cut[1:], strict=False)]

    def aligned(self, texts: list[str | None]) -> Iterator[list[tuple] | None]:
        """Of each text the alignments of its windows, None for a text without tokens."""
        some, size = [], 0
        for t in texts:
            if some and (len(some) >= _TEXTS or size + len(t or "") > _CHARS):
                yield from self._aligned(some)
                some, size = [], 0
            some.append(t)
            size += len(t or "")
        yield from self._aligned(some)

    def _aligned(self, texts: list[str | None]) -> Iterator[list[tuple] | None]:
        if len(self.words) >= KNOWN:
            self.older, self.words = self.words, {}
        words = [self.split(t) if t else [] for t in texts]
        found = [list(map(self.words.get, ws)) for ws in words]
        gaps = [[i for i, x in enumerate(xs) if x is None] for xs in found]
        new = {ws[i] for ws, gap in zip(words, gaps, strict=True) for i in gap}
        old = {w: x for w in new if (x := self.older.get(w)) is not None}
        self.words.update(old)
        new.difference_update(old)
        plain = [w for w in new if " " not in w and not w[:1].isspace()]
        fresh: dict = {}
        for k in range(0, len(plain), _NEW):
            self._learn(plain[k:k + _NEW], fresh)
        for w in new:
            if w not in fresh:
                self._learn([w], fresh)
        self.words.update((w, x) for w, x in fresh.items() if len(w) <= LONGEST)
        fresh.update(old)
        for text, ws, windows, gap in zip(texts, words, found, gaps, strict=True):
            for i in gap:
                windows[i] = fresh[ws[i]]
            if not all(windows):  # no anchors between some of its words: the text is one window, if its bytes agree
                both = self.sides.both(text)
                windows = self.align(both, [np.zeros(1, dtype=np.int64)] * 2) if both else []
            yield windows or None


_ALIGNERS: dict[tuple[bytes, bytes], Aligner] = {}


def _aligner(shared) -> Aligner:
    files = shared.value
    if files not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[files] = Aligner(Sides(*files))
    return _ALIGNERS[files]


def _shared(df: DataFrame, a_path: str, b_path: str):
    """Both tokenizers' files, of a fixed size, for every executor."""
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append(f.read())
    return ready(df).sparkSession.sparkContext.broadcast(tuple(files))


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, groups array<struct<a array<int>, b array<int>>>)`` of every row, empty for a text without tokens."""
    shared = _shared(docs, a_path, b_path)
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches):
        aligner = _aligner(shared)
        for b in batches:
            out = []
            for found in aligner.aligned(b.column(1).to_pylist()):
                groups = (g.split("|") for w in found or () for g in w[3].split(";"))
                out.append([{s: list(map(int, ids.split(","))) for s, ids in zip("ab", g, strict=True)} for g in groups])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=[id_col, "groups"])

    name = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {name}, groups array<struct<a:array<int>,b:array<int>>>")


def _kind(pairs: int) -> str:
    """The type of places among so many pairs."""
    return "<u2" if pairs <= 1 << 16 else "<i4"


def _blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """One stored row a block: per document its id, counts, digest and number of links; the links as places in the block's sorted pairs, compressed; the pairs with their numbers."""
    shared = _shared(docs, a_path, b_path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        aligner, task = _aligner(shared), TaskContext.get().partitionId()
        number, rows, links, held = 0, [], [], 0

        def block():
            flat = np.frombuffer(b"".join(links), dtype=np.int64)
            pairs, places, ns = np.unique(flat, return_inverse=True, return_counts=True)
            places = pa.compress(places.astype(_kind(len(pairs))).tobytes(), codec="zstd", asbytes=True)
            ids, n_a, n_b, n_groups, shas, n_links = zip(*rows, strict=True)
            lists = [pa.array([x], pa.list_(k)) for x, k in ((ids, id_type), (n_a, pa.int64()), (n_b, pa.int64()), (n_groups, pa.int64()), (shas, pa.string()), (n_links, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number]), *lists, pa.array([places], pa.binary()), pa.array([pairs], pa.list_(pa.int64())), pa.array([ns], pa.list_(pa.int64()))],
                                              names=["block", "ids", "n_a", "n_b", "n_groups", "shas", "n_links", "places", "pairs", "ns"])

        gc.disable()  # nothing here refers to itself, and remembered words are many to look through
        for b in batches:
            id_type = b.schema.field(0).type
            for key, found in zip(b.column(0).to_pylist(), aligner.aligned(b.column(1).to_pylist()), strict=True):
                held += DOCUMENT
                if found is None:
                    rows.append((key, 0, 0, 0, "", 0))
                else:
                    n_a, n_b, n_groups, texts, own = zip(*found, strict=True)
                    own = b"".join(own)
                    rows.append((key, sum(n_a), sum(n_b), sum(n_groups), sha256(";".join(texts).encode()).hexdigest(), len(own) // 8))
                    links.append(own)
                    held += len(own) // 8
                if held >= LINKS:
                    yield block()
                    number, rows, links, held = number + 1, [], [], 0
        if rows:
            yield block()
        gc.enable()

    schema = f"block long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, shas array<string>, n_links array<long>, places binary, pairs array<long>, ns array<long>"
    return stored(docs.select(id_col, text_col).mapInArrow(run, schema), "align-blocks", rows_a_file=ROWS)


def _numbers(blocks: DataFrame) -> DataFrame:
    """``(pair, n)``: links of each id pair over all blocks."""
    return blocks.select(F.inline(F.arrays_zip("pairs", "ns")).alias("pair", "k")).groupBy("pair").agg(F.sum("k").alias("n"))


def link_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(a_id, b_id, n)``: how often each id pair is linked in all documents."""
    pair = F.col("pair")
    return _numbers(_blocks(docs, a_path, b_path, id_col, text_col)).select(F.shiftright(pair, 20).cast("int").alias("a_id"), pair.bitwiseAND(_ID - 1).cast("int").alias("b_id"), "n")


def alignment_summary(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    blocks = _blocks(docs, a_path, b_path, id_col, text_col)
    numbers = stored(_numbers(blocks).withColumn("b", F.col("pair").bitwiseAND(_ID - 1)), "align-numbers")
    most = numbers.groupBy("b").agg(F.max("n").alias("most"))
    value = numbers.join(most, "b").select("pair", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("value"))
    seen = blocks.select("block", F.explode("pairs").alias("pair"))
    known = seen.join(value, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "value")).alias("known"))  # bounded by the block's links
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                get = lambda name: b.column(name)[r]  # noqa: B023, E731
                n = np.array(get("n_links").as_py(), dtype=np.int64)
                known = get("known").values
                if known is not None:
                    width = np.dtype(_kind(len(known)))
                    places = np.frombuffer(pa.decompress(get("places").as_buffer(), int(n.sum()) * width.itemsize, codec="zstd"), dtype=width)
                    pair, value = (known.field(k).to_numpy(zero_copy_only=False) for k in ("pair", "value"))
                    at = value[np.argsort(pair)][places]
                    sums = [np.r_[0, np.cumsum(x)] for x in (at & 1, at >> 1)]
                else:
                    sums = [np.zeros(1, np.int64)] * 2
                ends = np.cumsum(n)
                best, total = (s[ends] - s[ends - n] for s in sums)
                cols = [get(c).values for c in ("ids", "n_a", "n_b", "n_groups")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.array(best), pa.array(total), get("shas").values], names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    whole = blocks.drop("pairs", "ns").join(known, "block", "left")
    return whole.mapInArrow(run, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
