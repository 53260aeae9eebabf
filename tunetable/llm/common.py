"""What several operators of this package share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package, small_batches

#: White space of the contracts, ``[\x20\x09-\x0D]``. ``bytes.split()`` uses the same six characters.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ODD = np.uint64(0x9E3779B97F4A7C15)


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` once into the cluster's shared folder and read it back.

    Cuts the lineage with a copy that outlives executors; several branches of
    a plan then read it instead of computing it again. ``rows_a_file`` bounds
    the rows of a file, and so what a task holds of long rows (0: as the session has it).
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    writer = df.write.option("compression", "zstd").partitionBy(*partition_by)
    (writer.option("maxRecordsPerFile", rows_a_file) if rows_a_file else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ready(df: DataFrame) -> DataFrame:
    """Make this package importable in the executors' Python workers and keep their batches small."""
    spark = df.sparkSession
    ship_package(spark)
    small_batches(spark)
    return df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: str | None) -> list[bytes]:
    """``[^\x20\x09-\x0D]+`` of the text, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit numbers of words, equal for equal words on every executor."""

    def __init__(self, most: int = 200_000) -> None:
        self.most, self.known = most, {}

    def __call__(self, ws: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(ws).difference(known):
            known[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, ws), dtype=np.uint64, count=len(ws))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The number of each run of ``k`` words, from the words' numbers."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k if n > 0 else 0):
        out = mix(out * _ODD + h[i:i + n])
    return out
