"""Tokenizer JSON as tables (S4): ``vocab(token, id)`` and ``merges(rank, left, right)``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..resources import default_tokenizer_path
from ..session import open_input


def read_vocab(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Explode a tokenizer JSON into (vocab, merges); the default one when no path is given.

    The file is configuration of a fixed size that the driver reads, so
    executors need not see it. Special tokens are part of the vocabulary.
    """
    with open_input(path or default_tokenizer_path()) as f:
        spec = json.loads(f.read().decode("utf-8"))
    model = spec["model"]
    vocab = dict(model["vocab"]) | {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    pairs = [m.split(" ", 1) if isinstance(m, str) else list(m) for m in model.get("merges", ())]
    raw = spark.createDataFrame([(vocab, pairs)], "vocab map<string,int>, merges array<array<string>>")
    merges = raw.select(F.posexplode("merges").alias("rank", "m"))
    return raw.select(F.explode("vocab").alias("token", "id")), merges.select("rank", F.col("m")[0].alias("left"), F.col("m")[1].alias("right"))
