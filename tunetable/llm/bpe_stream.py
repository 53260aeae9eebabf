"""Byte-level BPE as a streaming transducer with bounded lookahead.

A merge that happens or not because of bytes further right can change tokens
further left only through a chain of merges of rising rank, in which the left
part of one merge is the right part of the next (the part set free looks for a
partner to its left). ``MergeTable.lookahead`` is the greatest reach in bytes
of such a chain, found by dynamic programming over the merge list from the
last rank to the first. A token that ends at least that far before the end of
what has been read is final: ``Transducer`` emits it and forgets its bytes, so
its memory depends on the merge list, not on the input.

Decoding walks the ids through an incremental byte-to-text state machine that
holds at most an unfinished UTF-8 sequence; faulty bytes become U+FFFD.

Defined cases: a null or empty text has no ids and decodes to the empty text;
repeated rows each get their own result; columns that are not asked for pass
by untouched; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ready

#: White space as the tokenizer's pattern sees it (Unicode White_Space).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Bytes that wait at most before the transducer works on them, beside its lookahead.
_CHUNK = 2048
#: Words, and pieces, whose ids a worker remembers for now, and the longest such word.
_KNOWN, _LONGEST = 150_000, 64
#: Characters that ``encode_parts`` holds before it works on them, and of a part of ``spell``.
_HOLD, _PART = 4096, 1 << 16
_ID, _NO = (1 << 20) - 1, 1 << 62


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the tokenizer's file: printable ones for themselves, the others from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        c = chr(b)
        if c.isprintable() and c != " " and b != 0xAD:
            out.append(c)
        else:
            out.append(chr(spare))
            spare += 1
    return out


class MergeTable:
    """Ids, merges and lookahead of a byte-level BPE tokenizer file."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.ids = list(range(max(vocab.values()) + 1))
        self.start = [vocab.get(c) for c in symbols]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a], vocab[b]] = rank, vocab[a + b]
        #: By a pair's ids: its rank above the id that it makes.
        self.steps = {a << 20 | b: rank << 20 | new for (a, b), (rank, new) in self.pairs.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.decimals = {i: str(i) for i in self.bytes_of}
        #: The step of each pair of bytes, by 256 times the first and the second.
        self.byte_steps = [_NO if a is None or b is None else self.steps.get(a << 20 | b, _NO) for a in self.start for b in self.start]
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        reach: dict[int, int] = {}  # by right part: bytes to its left that merges of a higher rank can still change
        most = 0
        for (a, b), _ in sorted(self.pairs.items(), key=lambda x: -x[1][0]):
            own = len(self.bytes_of[a]) + reach.get(a, 0)
            reach[b] = max(reach.get(b, 0), own)
            most = max(most, own + len(self.bytes_of[b]))
        return most + max(map(len, self.bytes_of.values()))

    def merge(self, data: bytes) -> list[int]:
        """The ids of a piece: the pair of lowest rank first, the leftmost of equals."""
        ids, get = list(map(self.start.__getitem__, data)), self.steps.get
        steps = [self.byte_steps[a << 8 | b] for a, b in zip(data, data[1:], strict=False)]
        while steps and (step := min(steps)) != _NO:
            i = steps.index(step)
            ids[i:i + 2] = [new] = [step & _ID]
            del steps[i]
            if i:
                steps[i - 1] = get(ids[i - 1] << 20 | new, _NO)
            if i < len(steps):
                steps[i] = get(new << 20 | ids[i + 1], _NO)
        return list(map(self.ids.__getitem__, ids))  # one object per id, however many words hold it


class Transducer:
    """Bytes of one piece in, final ids out."""

    def __init__(self, table: MergeTable) -> None:
        self.table, self.held = table, b""

    def feed(self, data: bytes) -> Iterator[int]:
        for k in range(0, len(data), _CHUNK):
            self.held += data[k:k + _CHUNK]
            if len(self.held) >= self.table.lookahead + _CHUNK:
                limit, done = len(self.held) - self.table.lookahead, 0
                for i in self.table.merge(self.held):
                    if done + (n := len(self.table.bytes_of[i])) > limit:
                        break
                    done += n
                    yield i
                self.held = self.held[done:]

    def finish(self) -> list[int]:
        out, self.held = self.table.merge(self.held), b""
        return out


class Encoder:
    """Encodes whole texts, or texts that come in parts; remembers the ids of common words."""

    def __init__(self, table: MergeTable) -> None:
        import regex

        self.table, self.pieces = table, regex.compile(_PIECES)
        self.odd = regex.compile(rf" (?=[{_SPACE}]|\Z)")
        self.spans = regex.compile("|".join(map(regex.escape, sorted(table.special, key=len, reverse=True))) or r"(?!)")
        self.border = regex.compile(rf"(?r) (?=[^{_SPACE}])")
        self.known = _Remembered(self.piece)
        self.first, self.rest = _Remembered(self.word), _Remembered(lambda w: self.word(" " + w))
        self.ahead = regex.compile(rf" (?=[^{_SPACE}])")
        self.spelled_piece = _Remembered(lambda p: self._spelled(self.piece(p)))
        self.spelled_word = _Remembered(self._spelled_from)

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece, as a tuple of numbers: the collector of cycles doesn't go through those that are remembered."""
        data = piece.encode("utf-8", "surrogatepass")
        if len(data) <= _CHUNK:
            return tuple(self.table.merge(data))
        t = Transducer(self.table)
        return (*t.feed(data), *t.finish())

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of what stands between two blanks, with the blank before it."""
        if word.lstrip(" ").isalpha():
            return self.known[word]
        return tuple(i for p in self.pieces.findall(word) for i in self.known[p])

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens. A blank before a non-blank always starts a piece, so words stand alone."""
        if not text:
            return []
        if self.odd.search(text):
            return list(chain.from_iterable(map(self.known.__getitem__, (m.group() for m in self.pieces.finditer(text)))))
        head, *tail = text.split(" ")
        return [*self.first[head], *chain.from_iterable(map(self.rest.__getitem__, tail))]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out, at = [], 0
        for m in self.spans.finditer(text):
            out += self.plain(text[at:m.start()])
            out.append(self.table.special[m.group()])
            at = m.end()
        return out + self.plain(text[at:] if at else text)

    def forget(self) -> None:
        """Give back what words take, so that a worker between tasks holds the tables only."""
        for known in (self.known, self.first, self.rest, self.spelled_piece, self.spelled_word):
            known.clear()
            known.older = {}

    def _spelled(self, ids: tuple[int, ...]) -> tuple[int, str, bytes]:
        return len(ids), ",".join([self.table.decimals[i] for i in ids]), b"".join([self.table.bytes_of[i] for i in ids])

    def _spelled_from(self, word: str) -> tuple[int, str, bytes]:
        """A word with the blank before it: one piece where it has letters only, else from its remembered pieces."""
        if word.isalpha():
            return self._spelled(self.piece(" " + word))
        if word[-1] in ".," and word[:-1].isalpha():
            (n, ids, data), (m, more, end) = self.spelled_word[word[:-1]], self.spelled_piece[word[-1]]
            return n + m, f"{ids},{more}", data + end
        parts = self.pieces.findall(" " + word)
        return self._joined([self.spelled_word[p[1:]] if p[0] == " " and p[1:].isalpha() else self.spelled_piece[p] for p in parts])

    def _joined(self, spelled: list[tuple[int, str, bytes]]) -> tuple[int, str, bytes]:
        n, ids, data = zip(*spelled, strict=True)
        return sum(n), ",".join(ids), b"".join(data)

    def spell(self, text: str) -> Iterator[tuple[int, str, bytes]]:
        """The text's ids in parts of some ``_PART`` characters: their number, the decimal ids, and their bytes.

        Parts end before a blank that starts a piece, so the ids of a part are
        final when it ends. A stretch without such a blank is one part, of which
        long pieces go through the transducer bit by bit.
        """
        at = 0
        for m in chain(self.spans.finditer(text), (None,)):
            end = m.start() if m else len(text)
            while at < end:
                cut = end
                if end - at > _PART:
                    border = self.border.search(text, at + 1, at + _PART) or self.ahead.search(text, at + _PART, end)
                    cut = border.start() if border else end
                yield self._part(text[at:cut])
                at = cut
            if m:
                yield self._spelled([self.table.special[m.group()]])
                at = m.end()

    def _part(self, part: str) -> tuple[int, str, bytes]:
        if self.odd.search(part):
            spelled = [self.spelled_piece[m.group()] for m in self.pieces.finditer(part)]
        else:
            head, *tail = part.split(" ")
            spelled = list(map(self.spelled_word.__getitem__, tail))
            if head:
                spelled.insert(0, self._spelled(self.word(head)))
        return self._joined(spelled)

    def encode_parts(self, parts: Iterable[str]) -> Iterator[int]:
        """Ids of the text that the parts make together, as soon as they are final.

        What waits is cut at the last blank before a non-blank; if there is
        none, pieces that end well before the end of what waits are final,
        and a single long piece goes through a ``Transducer``.
        """
        held = ""
        longest = max(map(len, self.table.special), default=0)
        for part in parts:
            held += part
            while len(held) >= _HOLD:
                body = held[:len(held) - longest]  # a special token may still begin in the rest
                if m := self.spans.search(held):
                    yield from self.plain(held[:m.start()])
                    yield self.table.special[m.group()]
                    held = held[m.end():]
                    continue
                cut = self.border.search(body)
                if not cut or not cut.start():
                    break
                yield from self.plain(body[:cut.start()])
                held = held[cut.start():]
        yield from self.encode(held)


class _Remembered(dict):
    """What ``make`` gives for a key. At ``_KNOWN`` keys the dictionary becomes the older one, from which keys that are still in use come back."""

    def __init__(self, make: Callable[[str], tuple]) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> tuple:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > _LONGEST:
                return value
        if len(self) >= _KNOWN:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Decoder:
    """Ids in, text out; holds an unfinished UTF-8 sequence between calls."""

    def __init__(self, table: MergeTable) -> None:
        self.get = table.bytes_of.get
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self.feed_bytes(b"".join(self.get(i, b"") for i in ids), last)

    def feed_bytes(self, data: bytes, last: bool = False) -> str:
        """The text that the bytes of further ids complete."""
        return self.state.decode(data, last)


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(shared) -> Encoder:
    content = shared.value
    if content not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[content] = Encoder(MergeTable(content))
    return _ENCODERS[content]


def _shared(df: DataFrame, path: str):
    """The tokenizer's file, of a fixed size, for every executor."""
    with open(path, "rb") as f:
        return ready(df).sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every row."""
    shared = _shared(docs, path)

    def run(batches):
        e = _encoder(shared)
        for b in batches:
            ids = [e.encode(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])
        e.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` of every row; null ids decode to the empty text, unknown ids to nothing."""
    shared = _shared(encoded, path)

    def run(batches):
        table = _encoder(shared).table
        for b in batches:
            texts = [Decoder(table).feed(x.as_py() or [], True) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every row in one pass: ``(id, n_tokens, ids_sha256, decoded_sha256)``.

    Ids are hashed and decoded part by part as they become final; neither the
    ids of a text nor its decoded form are ever held whole.
    """
    shared = _shared(docs, path)

    def run(batches):
        e = _encoder(shared)
        for b in batches:
            rows = []
            for t in b.column(1):
                d, ids, back, total = Decoder(e.table), sha256(), sha256(), 0
                for n, decimal, data in e.spell(t.as_py() or ""):
                    ids.update((f",{decimal}" if total else decimal).encode())
                    back.update(d.feed_bytes(data).encode())
                    total += n
                back.update(d.feed_bytes(b"", True).encode())
                rows.append((total, ids.hexdigest(), back.hexdigest()))
            n, i, t = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(t, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        e.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
