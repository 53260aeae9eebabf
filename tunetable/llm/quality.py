"""Quality rules: base counts, and line labels by a linear-chain conditional random field.

Each line of a text is described by yes/no features (length, ending, share of
marks, capitals, digits and stop words, repetition). A two-state chain over the
lines, content and boilerplate, is trained by gradient ascent on the
conditional likelihood. Labels are given for documents only, so training
alternates: lines start with their document's label; then lines of poor
documents are decoded again by the model and those that it takes for content
become content, as long as their document keeps mostly boilerplate. Viterbi
decoding labels the lines of every whole text; the characters in content lines
must make up ``SHARE`` of all for the text to be kept.

Training uses a bounded sample (``Bounds``); lines and counts of every scored
text are complete.

Defined cases: null and empty texts have no words, fail the base rules and are
not kept; rows with null ids are scored like others and never trained on;
repeated rows get equal results; without labels of both kinds the verdict is
that of the base rules; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .html_text import STOP_WORDS

SHARE = 0.5
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_LETTERS = re.compile(r"[^\W\d_]+")
_SEED = 5


@dataclass(frozen=True)
class Bounds:
    """What training reads at most: documents of either label, and characters of each."""

    rows_per_label: int = 1500
    chars_per_label: int = 12_000_000


@dataclass
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def repeated(ws: list[str]) -> np.ndarray:
    """For each word, whether a window of ``WINDOW`` words around it occurs twice or more. Windows are compared exactly."""
    n = len(ws) - WINDOW + 1
    out = np.zeros(len(ws), dtype=bool)
    if n < 2:
        return out
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in ws), dtype=np.int64, count=len(ws))
    run = ids[:n]
    for i in range(1, WINDOW):
        _, run = np.unique(run * len(known) + ids[i:i + n], return_inverse=True)
    twice = np.bincount(run)[run] > 1
    for i in range(WINDOW):
        out[i:i + n] |= twice
    return out


def count(text: str) -> Counts:
    ws = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return Counts(len(ws), sum(map(len, ws)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), int(repeated(ws).sum()))


FEATURES = 16


def describe(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``(lines x FEATURES, characters)`` of the text's lines that have a word."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        ws = line.split()
        if not ws:
            continue
        n, size = len(ws), sum(map(len, ws))
        plain = _LETTERS.findall(line)
        marks, letters = len(_SYMBOL.findall(line)), sum(map(len, plain))
        stops = sum(w in STOP_WORDS for w in map(str.lower, plain)) / n
        upper = sum(w.isupper() for w in plain if len(w) > 1)
        fresh, odd = len(set(ws)) / n, (size - letters) / size
        rows.append((
            1, n < 4, 4 <= n < 12, n >= 30, line.rstrip()[-1:] in ".!?:\"", marks > 0.02 * size, marks > 0.1 * size, upper > 0.5 * len(plain),
            any(c.isdigit() for c in line), stops >= 0.2, stops < 0.05, "|" in line, line in seen, fresh < 0.5 and n >= 8, odd > 0.15, size > 12 * n,
        ))
        seen.add(line)
        sizes.append(size)
    return np.array(rows, dtype=np.float64).reshape(-1, FEATURES), np.array(sizes, dtype=np.int64)


@dataclass
class Chain:
    """State 1 is content. ``emit``: weights of a line's features for content; ``step``: of pairs of states; ``first``: of the first state."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))
    trained: bool = False

    def viterbi(self, x: np.ndarray) -> list[int]:
        if not len(x):
            return []
        e = (x @ self.emit).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = float(self.first[0]), float(self.first[1]) + e[0]
        back = []
        for v in e[1:]:
            p0, p1 = a + s00 < b + s10, a + s01 < b + s11
            a, b = (b + s10 if p0 else a + s00), (b + s11 if p1 else a + s01) + v
            back.append((p0, p1))
        state = int(b > a)
        out = [state]
        for p in reversed(back):
            state = int(p[state])
            out.append(state)
        return out[::-1]

    def content_share(self, text: str) -> float:
        x, sizes = describe(text)
        return float((np.array(self.viterbi(x)) * sizes).sum() / sizes.sum()) if len(x) else 0.0


def _gradient(c: Chain, x: np.ndarray, y: np.ndarray, inside: np.ndarray):
    """Of the conditional likelihood of padded sequences x (docs, time, features), y, inside (docs, time)."""
    docs, time = y.shape
    pot = np.zeros((docs, time, 2))
    pot[..., 1] = x @ c.emit
    fwd, bwd = np.zeros((time, docs, 2)), np.zeros((time, docs, 2))
    fwd[0] = pot[:, 0] + c.first
    for t in range(1, time):
        z = fwd[t - 1][:, :, None] + c.step[None]
        fwd[t] = np.where(inside[:, t, None], np.logaddexp(z[:, 0], z[:, 1]) + pot[:, t], fwd[t - 1])
    total = np.logaddexp(fwd[-1][:, 0], fwd[-1][:, 1])
    for t in range(time - 2, -1, -1):
        z = c.step[None] + (pot[:, t + 1] + bwd[t + 1])[:, None, :]
        bwd[t] = np.where(inside[:, t + 1, None], np.logaddexp(z[..., 0], z[..., 1]), 0)
    node = np.exp(np.minimum(fwd + bwd - total[None, :, None], 0)) * inside.T[:, :, None]
    one = np.stack([y == 0, y == 1], -1) & inside[..., None]
    g_emit = np.einsum("dtf,dt->f", x, one[..., 1] - node.transpose(1, 0, 2)[..., 1])
    g_first = one[:, 0].sum(0) - node[0].sum(0)
    g_step = np.zeros((2, 2))
    for t in range(1, time):
        on = inside[:, t]
        if not on.any():
            break
        p = np.exp(fwd[t - 1][on][:, :, None] + c.step[None] + (pot[on, t] + bwd[t][on])[:, None, :] - total[on][:, None, None])
        g_step -= p.sum(0)
        np.add.at(g_step, (y[on, t - 1], y[on, t]), 1)
    return g_emit, g_step, g_first


def _climb(c: Chain, seqs: list[np.ndarray], labels: list[np.ndarray], turns: int = 120) -> Chain:
    """Gradient ascent with per-weight step sizes. Sequences are cut into runs of 64 lines for padding; borders only cost a pair."""
    cut = [(x[k:k + 64], y[k:k + 64]) for x, y in zip(seqs, labels, strict=True) for k in range(0, len(x), 64)]
    time = max(len(x) for x, _ in cut)
    x, y, inside = np.zeros((len(cut), time, FEATURES)), np.zeros((len(cut), time), dtype=np.int64), np.zeros((len(cut), time), dtype=bool)
    for i, (a, b) in enumerate(cut):
        x[i, :len(a)], y[i, :len(a)], inside[i, :len(a)] = a, b, True
    w = np.r_[c.emit, c.step.ravel(), c.first]
    speed = np.zeros_like(w)
    for turn in range(turns):
        g = np.r_[tuple(v.ravel() for v in _gradient(Chain(w[:FEATURES], w[FEATURES:-2].reshape(2, 2), w[-2:]), x, y, inside))] / len(cut) - 0.002 * w
        speed = 0.9 * speed + 0.1 * g * g
        w = w + 0.1 / (1 + turn / 40) * g / np.sqrt(speed + 1e-8)
    return Chain(w[:FEATURES], w[FEATURES:-2].reshape(2, 2), w[-2:], True)


def fit(sample: Iterable[tuple[str | None, int]], bounds: Bounds = Bounds()) -> Chain:
    """Train from ``(text, quality)`` pairs."""
    left, seqs, good = {0: bounds.chars_per_label, 1: bounds.chars_per_label}, [], []
    for text, label in sample:
        if text and len(text) <= left[label] and len(x := describe(text)[0]):
            left[label] -= len(text)
            seqs.append(x)
            good.append(label)
    if len(set(good)) < 2:
        return Chain()
    labels = [np.full(len(x), k, dtype=np.int64) for x, k in zip(seqs, good, strict=True)]
    c = _climb(Chain(), seqs, labels)
    for i, (x, k) in enumerate(zip(seqs, good, strict=True)):
        if not k and (y := np.array(c.viterbi(x))).mean() < 0.5:
            labels[i] = y
    return _climb(c, seqs, labels, 40)


def train(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Chain:
    """Fit on labelled rows whose crc32 of the id isn't divisible by 5: per label the first ones by a hash of the id."""
    used = F.crc32(F.col(id_col).cast("string")) % 5 != 0
    marked = labels.filter(used & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"))
    order = F.xxhash64(F.lit(_SEED), id_col)
    chosen = [marked.filter(F.col("label") == k).orderBy(order, id_col).limit(bounds.rows_per_label) for k in (0, 1)]
    ids = {r[0]: r[1] for c in chosen for r in c.collect()}  # at most 2 * rows_per_label ids
    if not ids:
        return Chain()
    few = docs.sparkSession.createDataFrame(list(ids.items()), f"`{id_col}` {labels.schema[id_col].dataType.simpleString()}, label int")
    sample = docs.select(id_col, text_col).join(F.broadcast(few), id_col).orderBy(order, id_col, text_col).select(text_col, "label")
    return fit(((r[0], r[1]) for r in sample.toLocalIterator()), bounds)


def judge(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, the base counts, ``base_failed``, ``kept`` and ``content_share`` (null if the base rules fail)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                c = count(t := t.as_py() or "")
                share = None if c.failed else chain.content_share(t) if chain.trained else 1.0
                rows.append((*(getattr(c, n) for n in names), c.failed, share is not None and share >= SHARE, share))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip(cols, kinds, strict=True))], names=["doc_id", *names, "base_failed", "kept", "content_share"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean, content_share double"
    return ready(docs).select(id_col, text_col).mapInArrow(run, schema)
