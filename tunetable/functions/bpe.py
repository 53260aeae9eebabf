"""Byte-pair encoding of text columns (F2) and its inverse.

Whole documents are tokenised by an Arrow iterator UDF: the model and a
per-task word cache are built once per task and every batch is returned as one
Arrow list array (no per-row pandas objects). The model is a fixed-size
parameter (vocabulary + merges); it is broadcast once per application, and the
data never passes the driver. ``functions.bpe_tables`` does the same for
distinct words with joins alone.

Rules (tokenizer JSON layout: ``added_tokens``, ``model.vocab``,
``model.merges``, ``model.unk_token``):

* special (added) tokens are matched first;
* the rest is split into pieces by the pattern that the file names, or by
  ``\\w+|[^\\w\\s]+`` (Unicode ``\\w``); what no piece holds, whitespace above
  all, is dropped;
* each piece starts as single characters (the stand-ins of its UTF-8 bytes in a
  byte-level file), the last with the file's end-of-word mark if it has one, and
  is merged lowest merge rank first, leftmost first; a character missing from
  the vocabulary becomes the unknown token, one per character, or nothing in a
  file without such a token;
* a blank is carried as the ``[SPACE]`` token where the file has it. Decoding
  puts a blank there, or after each end-of-word mark but the last.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches
from . import col_of

_PIECE = r"\w+|[^\w\s]+"
SPACE_TOKEN = "[SPACE]"
STOP_TOKEN = "[STOP]"
#: The longest segment whose ids a task remembers, and the bytes of text that it encodes at a time.
_LONGEST, _PART = 64, 1 << 20


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level file: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class BpeModel:
    vocab: dict
    ranks: dict
    specials: dict
    unk_id: int | None
    pattern: str = _PIECE
    suffix: str = ""
    byte_level: bool = False
    id_to_token: dict = field(default_factory=dict)
    _special_re: object = None

    def __post_init__(self):
        import regex
        self.id_to_token = {i: t for t, i in self.vocab.items()}
        for t, i in self.specials.items():
            self.id_to_token.setdefault(i, t)
        self._pieces = regex.compile(self.pattern)
        self._apart = self._pieces.findall("a b") == ["a", "b"]  # no piece holds a blank
        self.byte_symbols = byte_symbols() if self.byte_level else None
        if self.specials:
            alts = sorted(self.specials, key=len, reverse=True)
            self._special_re = re.compile("(" + "|".join(re.escape(s) for s in alts) + ")")

    # -- encoding ---------------------------------------------------------
    def _merge_word(self, word: str) -> list[int]:
        """Pairs wait in a heap by (rank, place); a pair that no longer stands when its turn comes is passed over."""
        syms: list = [self.byte_symbols[b] for b in word.encode("utf-8", "surrogatepass")] if self.byte_level else list(word)
        syms[-1] += self.suffix
        n = len(syms)
        get = self.ranks.get
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(syms, syms[1:])) if (r := get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if syms[i] != a or j >= n or syms[j] != b:
                continue
            syms[i], syms[j] = a + b, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := get((syms[i], syms[k]))) is not None:
                    heapq.heappush(heap, (r, i, syms[i], syms[k]))
            if (h := left[i]) >= 0 and (r := get((syms[h], syms[i]))) is not None:
                heapq.heappush(heap, (r, h, syms[h], syms[i]))
        v = self.vocab
        ids = [v.get(s, self.unk_id) for s in syms if s is not None]
        return [i for i in ids if i is not None] if self.unk_id is None else ids

    def _encode_segment(self, seg: str) -> list[int]:
        out: list[int] = []
        for piece in self._pieces.findall(seg):
            out.extend(self._merge_word(piece))
        return out

    def encode(self, text: str | None, cache: dict | None = None, cache_cap: int = 200_000):
        if text is None:
            return None
        space = self.specials.get(SPACE_TOKEN)
        others = [t for t in self.specials if t != SPACE_TOKEN]
        if space is not None and not any(t in text for t in others):
            # Fast path: no literal special token in the text, so blanks are the
            # only special matches; encode blank-separated segments, cached whole.
            out: list[int] = []
            cache = {} if cache is None else cache
            get, extend, append, enc = cache.get, out.extend, out.append, self._encode_segment
            for seg in text.split(" "):
                if seg:
                    ids = get(seg)
                    if ids is None:
                        ids = enc(seg)
                        if len(cache) >= cache_cap:
                            cache.clear()
                        if len(seg) <= _LONGEST:
                            cache[seg] = ids
                    extend(ids)
                append(space)
            out.pop()
            return out
        out = []
        text = text.replace(" ", SPACE_TOKEN) if space is not None else text
        parts = self._special_re.split(text) if self._special_re is not None else [text]
        for part in parts:
            if not part:
                continue
            sid = self.specials.get(part)
            if sid is not None:
                out.append(sid)
                continue
            out.extend(self._encode_segment(part))
        return out

    def encode_bytes(self, text: str, cache: dict, cache_cap: int = 200_000) -> bytes:
        """``encode`` as packed native int32 bytes; segments cached as bytes, so a
        document is one ``join`` (used by the UDF to build Arrow arrays directly)."""
        space = self.specials.get(SPACE_TOKEN)
        if not self._apart or any(t in text for t in self.specials if t != SPACE_TOKEN):
            return array("i", self.encode(text)).tobytes()
        sp = cache.get(None)
        if sp is None:
            sp = cache[None] = array("i", [space]).tobytes() if space is not None else b""
        # blank-separated segments -> cached id bytes, joined by the [SPACE] id (if the file has
        # one); an empty segment (two blanks in a row) is empty, giving two [SPACE]s
        segs = text.split(" ")
        parts = list(map(cache.get, segs))
        if None in parts:
            if len(cache) >= cache_cap:
                cache.clear()
                cache[None] = sp
            for i, b in enumerate(parts):
                if b is None:
                    seg = segs[i]
                    parts[i] = b = array("i", self._encode_segment(seg)).tobytes() if seg else b""
                    if len(seg) <= _LONGEST:
                        cache[seg] = b
        return sp.join(parts)

    # -- decoding ---------------------------------------------------------
    def fingerprint(self) -> str:
        """Content hash of vocabulary, merges and special tokens."""
        import hashlib
        h = hashlib.sha256()
        h.update(json.dumps(sorted(self.vocab.items())).encode())
        h.update(json.dumps(sorted((r, a, b) for (a, b), r in self.ranks.items())).encode())
        h.update(json.dumps(sorted(self.specials.items())).encode())
        return h.hexdigest()

    def piece_table(self) -> np.ndarray:
        """Decoded bytes of every id (a blank for ``[SPACE]`` and the end-of-word mark, nothing for
        other specials and unknown ids), as an object array indexed by id."""
        back = {c: b for b, c in enumerate(self.byte_symbols)} if self.byte_level else None
        table = np.array([b""] * (max(self.id_to_token) + 2), dtype=object)
        for i, t in self.id_to_token.items():
            end = b" " if self.suffix and t.endswith(self.suffix) else b""
            t = t.removesuffix(self.suffix) if end else t
            if t == SPACE_TOKEN:
                table[i] = b" "
            elif t not in self.specials:
                table[i] = (bytes(back[c] for c in t) if back else t.encode("utf-8", "surrogatepass")) + end
        return table

    def text_of(self, pieces) -> str:
        text = b"".join(pieces).decode("utf-8", "replace")
        return text.removesuffix(" ") if self.suffix else text

    def decode(self, ids) -> str | None:
        if ids is None:
            return None
        table = self.piece_table()
        return self.text_of(table[i] if 0 <= i < len(table) else b"" for i in ids)


def _parts_of(spec: dict | None) -> list[dict]:
    """The steps of a pre-tokenizer, one or a sequence."""
    return (spec.get("pretokenizers") or [spec]) if spec else []


def parse_tokenizer(spec: dict) -> BpeModel:
    model = spec["model"]
    vocab = {str(k): int(v) for k, v in model["vocab"].items()}
    ranks = {}
    for r, m in enumerate(model.get("merges", [])):
        a, b = (m.split(" ", 1) if isinstance(m, str) else m)
        ranks[(a, b)] = r
    specials = {t["content"]: int(t["id"]) for t in spec.get("added_tokens", [])}
    unk = model.get("unk_token") or "[UNK]"
    unk_id = vocab.get(unk, specials.get(unk))
    steps = _parts_of(spec.get("pre_tokenizer"))
    patterns = [p["pattern"]["Regex"] for p in steps if p["type"] == "Split" and p.get("invert") and "Regex" in p["pattern"]]
    return BpeModel(vocab=vocab, ranks=ranks, specials=specials, unk_id=unk_id, pattern=patterns[0] if patterns else _PIECE,
                    suffix=model.get("end_of_word_suffix") or "", byte_level=any(p["type"] == "ByteLevel" for p in steps))


def load_tokenizer(path: str) -> BpeModel:
    """Parse a tokenizer JSON (a small configuration file) on the driver; local path or URI."""
    from ..session import open_input
    with open_input(path) as f:
        return parse_tokenizer(json.loads(f.read().decode("utf-8")))


def _as_model(tok) -> BpeModel:
    return tok if isinstance(tok, BpeModel) else load_tokenizer(tok)


_BROADCASTS: dict = {}


def _broadcast_model(model: BpeModel):
    """One broadcast per tokenizer content and application: shipped once per
    executor, not per task, and reused when the same tokenizer is loaded again."""
    from pyspark import SparkContext
    sc = SparkContext.getOrCreate()
    key = (sc.applicationId, model.fingerprint())
    if key not in _BROADCASTS:
        _BROADCASTS[key] = sc.broadcast(model)
    return _BROADCASTS[key]


def _parts(arr: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, some ``_PART`` bytes at a time (a longer text alone)."""
    import pyarrow.compute as pc
    ends = np.cumsum(pc.binary_length(arr).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(arr):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + _PART, "right")))
        yield arr.slice(lo, hi - lo)
        lo = hi


def bpe_encode(text, tokenizer) -> Column:
    """Column of token ids (``array<int>``) for a string column.

    A task holds one Arrow batch, which the session's limits bound in bytes, and
    the ids of a part of it.
    """
    bc = _broadcast_model(_as_model(tokenizer))
    small_batches(SparkSession.getActiveSession())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = bc.value
        cache: dict = {}
        assert array("i").itemsize == 4
        for arr in (part for batch in batches for part in _parts(batch)):
            texts = arr.to_pylist()
            offsets = np.zeros(len(texts) + 1, dtype=np.int64)
            chunks: list[bytes] = []
            valid = np.ones(len(texts), dtype=bool)
            for i, t in enumerate(texts):
                if t is None:
                    valid[i] = False
                    offsets[i + 1] = offsets[i]
                    continue
                b = model.encode_bytes(t, cache)
                chunks.append(b)
                offsets[i + 1] = offsets[i] + len(b) // 4
            flat = np.frombuffer(b"".join(chunks), dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat),
                                           mask=pa.array(~valid))

    udf = F.arrow_udf(run, "array<int>")
    return udf(col_of(text))


def bpe_decode(ids, tokenizer) -> Column:
    """Inverse of ``bpe_encode``: blanks restored, special tokens dropped."""
    bc = _broadcast_model(_as_model(tokenizer))
    small_batches(SparkSession.getActiveSession())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = bc.value
        table = model.piece_table()
        for arr in batches:
            if isinstance(arr, pa.ChunkedArray):
                arr = arr.combine_chunks()
            offsets = arr.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            ids = arr.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = np.where((ids >= 0) & (ids < len(table)), ids, len(table) - 1)
            pieces = table[ids]
            nulls = arr.is_null().to_numpy(zero_copy_only=False)
            out = [None if nulls[i] else model.text_of(pieces[offsets[i]:offsets[i + 1]]) for i in range(len(arr))]
            yield pa.array(out, type=pa.string())

    udf = F.arrow_udf(run, "string")
    return udf(col_of(ids))
