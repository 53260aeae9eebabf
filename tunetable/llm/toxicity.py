"""Toxicity by compression distance.

Two zstandard dictionaries are trained from labelled text: one holds what is
significantly more frequent in toxic documents, one the opposite, and both end
in the same frequent ordinary words, so that ordinary wording compresses alike
under either. Every whole text is cut into short windows at word borders; a
window's gain is its compressed length with the ordinary dictionary minus the
one with the toxic dictionary. Documents whose best window passes a threshold
calibrated on ordinary training windows are looked at again with narrower
windows; a logistic calibration of the gains gives the score.

Dictionaries are raw content chosen by a likelihood-ratio test instead of the
library's trainer: the trainer's choice by raw frequency fills both
dictionaries with the wording that the classes share (measured: AUC 0.74
against 0.99).

Training uses a bounded sample (``Bounds``); near copies in it count once.

Defined cases: null and empty texts have no windows and get the score of a
document without evidence; rows with a null id are never trained on and count
as held out; repeated rows are scored one by one; without toxic or without
ordinary training rows every score is the share of toxic ones (0 if there are
no labels at all); an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, grams, mix, ready


@dataclass(frozen=True)
class Bounds:
    """What training reads and keeps at most."""

    toxic_rows: int = 3000
    ordinary_rows: int = 4000
    chars_per_class: int = 24_000_000
    own_bytes: int = 4096
    shared_bytes: int = 8192


_LEVEL, _WIDE, _NARROW, _SEED = 9, 40, 24, 10
_WORD = re.compile(r"[^\W\d_]+")
#: A word is taken into a dictionary from so many documents and this likelihood ratio on.
_SUPPORT, _RATIO = 5, 20.0
_STEMS = (4, 5, 6)
#: Minima of hashed word runs by which near copies in the sample are told; a quarter in common is enough.
_MARKS = 12
#: Share of the ordinary training windows that may pass the window threshold.
_FALSE_WINDOWS = 0.005


def windows(data: bytes, width: int) -> list[bytes]:
    """Consecutive windows that end at blanks; words beyond the width are cut."""
    return [b" " + w for w in re.findall(rb"(?s).{1,%d}(?: |$)|.{1,%d}" % (width - 1, width - 1), data)]


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").split())


def _gains(ws: list[bytes], toxic: Callable[[bytes], bytes], ordinary: Callable[[bytes], bytes]) -> np.ndarray:
    return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in ws), dtype=np.int32, count=len(ws))


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: int = 2
    weights: list[float] = field(default_factory=list)
    prior: float = 0.0

    def compressors(self) -> tuple[Callable[[bytes], bytes], ...]:
        import zstandard as zs

        out = []
        for content in (self.toxic, self.ordinary):
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=_LEVEL)
            out.append(zs.ZstdCompressor(level=_LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        return tuple(out)

    def evidence(self, text: str | None, tools: tuple) -> list[float]:
        data = normal(text)
        wide = _gains(windows(data, _WIDE), *tools)
        top = np.sort(wide)[-3:]
        best = int(top[-1]) if len(top) else 0
        out = [1.0, max(best, 0), float(np.maximum(top, 0).sum()), math.log1p(int((wide >= self.threshold + 1).sum())), math.log1p(len(wide)), 0.0, 0.0]
        if best >= self.threshold - 1:
            narrow = _gains(windows(data, _NARROW), *tools)
            out[5:] = [float(narrow.max()), math.log1p(int((narrow >= self.threshold + 1).sum()))]
        return out

    def score(self, evidence: list[float]) -> float:
        if not self.weights:
            return self.prior
        z = sum(a * b for a, b in zip(self.weights, evidence, strict=True))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def _packed(ws: Iterable[str], most: int) -> bytes:
    """The words, the first ones nearest to the end, where a dictionary's content is cheapest to refer to."""
    out = b""
    for w in ws:
        x = w.encode()
        if len(out) + len(x) + 1 > most:
            break
        if x not in out:
            out = b" " + x + out
    return out


def _ratio(a: int, n: int, b: int, m: int) -> float:
    """Likelihood ratio of a share a/n against b/m."""
    def log(k, of, p):
        return (k * math.log(p) if k else 0.0) + ((of - k) * math.log1p(-p) if of > k else 0.0)

    p = (a + b) / (n + m)
    return 2 * (log(a, n, a / n) + log(b, m, b / m) - log(a, n, p) - log(b, m, p))


def _units(text: str) -> set[str]:
    """The text's words and the beginnings of its longer ones, which inflected forms share."""
    ws = set(_WORD.findall(text.lower()))
    return ws | {w[:k] for w in ws for k in _STEMS if len(w) > k}


def fit(sample: Iterable[tuple[str | None, int]], share: float, bounds: Bounds = Bounds()) -> Model:
    """Train from ``(text, label)`` pairs; ``share``: toxic ones among all labels."""
    hasher, left = WordHasher(), {0: bounds.chars_per_class, 1: bounds.chars_per_class}
    texts: dict[int, list[str]] = {0: [], 1: []}
    owner: dict[tuple[int, int], int] = {}
    for number, (text, label) in enumerate(sample):
        if not text or len(text) > left[label]:
            continue
        left[label] -= len(text)
        ws = normal(text).split()
        g = grams(hasher(ws), min(4, max(len(ws), 1)))
        marks = [(k, int(mix(g ^ mix(np.uint64([k + 1]))).min())) for k in range(_MARKS)] if len(g) else []
        votes = Counter(owner[x] for x in marks if x in owner)
        if max(votes.values(), default=0) * 4 < _MARKS:  # else a near copy of an earlier one
            texts[label].append(text)
        for x in marks:
            owner.setdefault(x, number)
    n, m = len(texts[1]), len(texts[0])
    if not n or not m:
        return Model(b"", b"", prior=share)
    by = {label: Counter(w for t in ts for w in _units(t)) for label, ts in texts.items()}
    often = Counter(w for t in texts[0] for w in _WORD.findall(t.lower()))
    telling: dict[int, list[tuple[float, str]]] = {0: [], 1: []}
    for w in by[0].keys() | by[1].keys():
        a, b = by[1][w], by[0][w]
        if a + b >= _SUPPORT and len(w) > 2 and (r := _ratio(a, n, b, m)) >= _RATIO:
            telling[int(a / n > b / m)].append((-r, w))
    own = {k: _packed((w for _, w in sorted(v)), bounds.own_bytes) for k, v in telling.items()}
    common = _packed((w for w, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))), bounds.shared_bytes)
    model = Model(own[1] + common, own[0] + common)
    tools = model.compressors()
    plain = np.concatenate([_gains(windows(normal(t), _WIDE), *tools) for t in texts[0]] or [np.zeros(1)])
    model.threshold = max(2, math.ceil(float(np.quantile(plain, 1 - _FALSE_WINDOWS)))) if len(plain) else 2
    x = np.array([model.evidence(t, tools) for k in (1, 0) for t in texts[k]])
    y = np.r_[np.ones(n), np.zeros(m)]
    model.weights = _logistic(x, y, np.where(y == 1, share / n, (1 - share) / m) * (n + m))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Weighted logistic regression by Newton's method; the first column is the constant."""
    beta, keep = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag(keep), x.T @ (w * (y - p)) - keep * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the labelled rows that are not held out: per class the ``bounds`` first ones by a hash of the id."""
    marked = labels.filter(~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    share = marked.agg(F.avg("label")).first()[0]
    if share is None:
        return Model(b"", b"")
    order = F.xxhash64(F.lit(_SEED), id_col)
    chosen = [marked.filter(F.col("label") == k).orderBy(order, id_col).limit(n) for k, n in ((1, bounds.toxic_rows), (0, bounds.ordinary_rows))]
    ids = {r[0]: r[1] for c in chosen for r in c.collect()}  # at most toxic_rows + ordinary_rows ids
    if not ids:
        return Model(b"", b"", prior=share)
    few = docs.sparkSession.createDataFrame(list(ids.items()), f"`{id_col}` {labels.schema[id_col].dataType.simpleString()}, label int")
    sample = docs.select(id_col, text_col).join(F.broadcast(few), id_col).orderBy(order, id_col, text_col).select(text_col, "label")
    return fit(((r[0], r[1]) for r in sample.toLocalIterator()), share, bounds)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the column ``out`` (double, 0 to 1, higher for likelier toxic); a column of that name is replaced."""
    @F.pandas_udf("double")
    def rated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tools = model.compressors()
        for texts in batches:
            yield pd.Series([model.score(model.evidence(t, tools)) for t in texts], dtype="float64")

    return ready(docs).withColumn(out, rated(F.col(text_col)))
