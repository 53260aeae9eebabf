"""Batch scoring with a model loaded once per task.

The loader runs on the executor, outside the batch loop, so a model is
loaded once per task and reused for every Arrow batch of that task; nothing
but the loader's arguments (for example a path on shared storage) travels
from the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.codes import valid_matrix, vector_sums
from ..session import scratch_path
from .files import listed, whole
from .meeting import ROWS_PER_TASK, per_model


def score_batches(df: DataFrame, loader: Callable[[], object],
                  fn: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str,
                  batch: int | None = None) -> DataFrame:
    """Score ``df`` batch by batch; ``fn`` sees at most ``batch`` rows at once (default: a whole Arrow batch)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loader()
        for pdf in batches:
            step = batch or max(len(pdf), 1)
            for lo in range(0, max(len(pdf), 1), step):
                yield fn(model, pdf.iloc[lo:lo + step])

    return df.mapInPandas(run, schema)


def parquet_matrix_loader(path: str, key: str, values: str):
    """A loader that reads a small ``(key, values)`` Parquet table into a NumPy matrix."""
    def load():
        import numpy as np
        import pyarrow.parquet as pq
        from ..session import local_path
        if "://" in path and not path.startswith("file:"):
            from pyarrow import fs as pafs
            filesystem, inner = pafs.FileSystem.from_uri(path)
            t = pq.read_table(inner, columns=[key, values], filesystem=filesystem).sort_by(key)
        else:
            t = pq.read_table(local_path(path), columns=[key, values]).sort_by(key)
        keys = t.column(key).to_numpy()
        mat = np.array([np.asarray(v, dtype=np.float64) for v in t.column(values).to_pylist()])
        return keys, mat
    return load


class Conditioning:
    """Conditioning vectors, computed once a key and kept.

    ``embed(model, matrix) -> matrix`` turns the reference vectors of any keys
    into parts of a conditioning (one row each); a key's parts are averaged,
    partly before the shuffle, so a key may have any number of references; then
    ``finish(model, keys, matrix) -> matrix`` is called once for each key. What
    is computed goes to a folder of shared storage, one generation a call:
    later calls, of other batches, sessions or programs, read it and compute
    only the keys that are new. ``computed`` counts the keys finished by this
    object (an accumulator: a task that is run again counts again).
    """

    def __init__(self, spark: SparkSession, embed: Callable, finish: Callable, loader: Callable[[], object], dim: int, path: str | None = None) -> None:
        self.spark, self.embed, self.finish, self.loader, self.dim = spark, embed, finish, loader, dim
        self.path = path or scratch_path(spark, "conditioning")
        self.computed = spark.sparkContext.accumulator(0)

    def stored(self) -> DataFrame:
        """``(key, latent)`` of every key known so far; a generation that was not written to its end is not read."""
        schema = "key string, latent array<double>"
        paths = [f"{self.path}/{g}" for g in listed(self.spark, self.path) if whole(self.spark, f"{self.path}/{g}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def latents(self, requests: DataFrame, references: DataFrame, key_col: str, vec_col: str) -> DataFrame:
        """``(key, latent)`` for the keys of ``requests``, computed from ``references(key_col, vec_col)`` where they are new.

        Keys are compared as text. References of other keys are left out before
        any model sees them; null vectors and those of another width than
        ``dim`` count for nothing, and a key without any reference has no row.
        """
        wanted = requests.select(F.col(key_col).cast("string").alias("key")).filter("key IS NOT NULL").distinct()
        known = self.stored()
        new = wanted.join(known.select("key"), "key", "left_anti")
        refs = references.select(F.col(key_col).cast("string").alias("key"), F.col(vec_col).alias("x")).join(new, "key", "left_semi")
        embed, finish, loader, dim, computed = self.embed, self.finish, self.loader, self.dim, self.computed

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = loader()
            for b in batches:
                mask, x = valid_matrix(b.column(1), dim)
                if len(x):
                    yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(mask)), _lists(embed(model, x))], names=["key", "part"])

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = loader()
            for b in batches:
                if b.num_rows:
                    keys = b.column(0).to_pylist()
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
                    computed.add(len(keys))
                    yield pa.RecordBatch.from_arrays([b.column(0), _lists(finish(model, keys, x))], names=["key", "latent"])

        sums = vector_sums(refs.mapInArrow(parts, "key string, part array<double>"), "key", "part")
        means = sums.select("key", F.zip_with("sums", "counts", lambda s, n: s / n).alias("mean"))
        if not new.isEmpty():
            generation = scratch_path(self.spark, "x").rsplit("-", 1)[1]
            means.mapInArrow(ends, "key string, latent array<double>").write.parquet(f"{self.path}/{generation}")
        return self.stored().join(wanted, "key", "left_semi")


def _lists(x: np.ndarray) -> pa.ListArray:
    x = np.ascontiguousarray(x, dtype=np.float64)
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))


def score_conditioned(requests: DataFrame, latents: DataFrame, key_col: str, loader: Callable[[], object], fn: Callable,
                      schema: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``fn(model, latent, batch)`` over all requests, in Arrow batches of one key.

    The model is loaded once a task, a key's conditioning read once for each
    task that meets it and never copied to its rows; a hot key is split by its
    count (``plans.meeting``). ``latent`` is None for rows whose key is null or
    has no conditioning.
    """
    def load(_model, struct):
        return struct["latent"].values.to_numpy(zero_copy_only=False)

    return per_model(latents.withColumnRenamed("key", key_col), requests, key_col, load, fn, schema, rows_per_task, loader)
