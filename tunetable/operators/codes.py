"""Vectors and codes: nearest-codebook assignment (J7) and pooling (A5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import col_of
from ..plans.joins import bytes_of, matrix_of
from ..plans.lineage import materialize
from ..plans.meeting import ROWS_PER_TASK


def _as_matrix(list_arr) -> np.ndarray:
    if isinstance(list_arr, pa.ChunkedArray):
        list_arr = list_arr.combine_chunks()
    n = len(list_arr)
    flat = list_arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def valid_matrix(list_arr, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask, matrix): rows that are non-null vectors of width ``dim``, as a float64 matrix."""
    if isinstance(list_arr, pa.ChunkedArray):
        list_arr = list_arr.combine_chunks()
    import pyarrow.compute as pc
    lengths = pc.list_value_length(list_arr).fill_null(-1).to_numpy(zero_copy_only=False)
    mask = lengths == dim
    if not mask.any():
        return mask, np.zeros((0, dim))
    sub = list_arr.filter(pa.array(mask))
    return mask, sub.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _nearest(x: np.ndarray, codes: np.ndarray, book: np.ndarray, book_sq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``x`` the least squared distance to ``book`` and its code, ties to the lowest code, both exact."""
    got_code, got_dist = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    step = max(1, 2_000_000 // max(len(codes), 1))  # the rows x codes matrix stays near 2M entries
    for lo in range(0, len(x), step):
        xs = x[lo:lo + step]
        own = (xs * xs).sum(axis=1)
        approx = own[:, None] - 2.0 * (xs @ book.T) + book_sq[None, :]
        best = approx.min(axis=1)
        # rounding grows with the norms that cancel, not with the distance that is left
        tol = 1e-9 * np.maximum(1.0, np.abs(best)) + 1e-12 * (own + book_sq.max())
        # exact re-scoring of every (row, code) pair within rounding of the row's best
        rows, cand = np.nonzero(approx <= (best + tol)[:, None])
        diff = xs[rows] - book[cand]
        exact = (diff * diff).sum(axis=1)
        order = np.lexsort((codes[cand], exact, rows))
        first = order[np.unique(rows[order], return_index=True)[1]]
        got_code[lo:lo + len(xs)], got_dist[lo:lo + len(xs)] = codes[cand[first]], exact[first]
    return got_code, got_dist


def assign_codes(vectors: DataFrame, codebook: DataFrame, id_col: str = "vec_id",
                 vec_col: str = "embedding", code_col: str = "code",
                 code_vec_col: str = "embedding", max_bytes: int = 256 << 20, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Nearest codebook entry by squared L2 for every vector; ties to the lowest code.

    A codebook of at most ``max_bytes`` is one block that every task gets; the
    vectors stay where they are. A larger one is cut into blocks of that size,
    and vectors meet, a chunk of them at a time, the blocks that may hold their
    nearest codes (``blocked_codes``). Either way a batch is scored with one matrix product,
    and candidates within rounding of the best are re-scored, so distances and
    ties are exact. Output: ``id, code, dist`` (double); a null or wrong-width
    vector gets null code and distance.
    """
    book = codebook.select(col_of(code_col).cast("long").alias("code"), col_of(code_vec_col).alias("v")).filter("v IS NOT NULL")
    if bytes_of(book, "v") > max_bytes:
        return blocked_codes(vectors, book, id_col, vec_col, code_col, max_bytes, rows_per_task)
    codes, matrix = matrix_of(book, max_bytes, "code", "v")
    bc = vectors.sparkSession.sparkContext.broadcast((codes, matrix, (matrix * matrix).sum(axis=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes_, book_, bsq = bc.value
        for b in batches:
            mask, x = valid_matrix(b.column(1), book_.shape[1])
            code_all, dist_all = np.zeros(len(b), dtype=np.int64), np.zeros(len(b))
            code_all[mask], dist_all[mask] = _nearest(x, codes_, book_, bsq)
            # a null or wrong-width vector keeps its row, with a null code
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code_all, mask=~mask), pa.array(dist_all, mask=~mask)],
                                             names=[id_col, code_col, "dist"])

    id_type = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vec_col).mapInArrow(run, f"{id_col} {id_type}, {code_col} long, dist double")


#: Vectors come in some ``CHUNKS`` chunks, of so many bytes as doubles at least and at most.
CHUNKS, CHUNK_BYTES = 64, (1 << 19, 32 << 20)


def blocked_codes(vectors: DataFrame, book: DataFrame, id_col: str, vec_col: str, code_col: str, block_bytes: int,
                  rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``assign_codes`` for a codebook ``(code, v)`` of any size.

    Codes are dealt by range of (norm, code) into blocks of some ``block_bytes``,
    vectors by range of norm into chunks of at most ``rows_per_task`` rows. A
    chunk first meets the blocks of its own norms, which gives distances; by
    the triangle inequality a code is farther away than the difference of the
    norms, so only blocks whose norms come nearer than that distance can hold a
    better code. The chunk meets those in a second turn, and the least of all
    (distance, code) is taken. A task holds one chunk and one Arrow batch of
    codes. Blocks travel to chunks, never vectors to blocks: a code is copied
    ``CHUNKS`` times at most while chunks stay below their greatest size.
    """
    book = materialize(book.select("code", F.col("v").cast("array<double>").alias("v")))
    dim = book.select(F.size("v")).first()[0]
    blocks = max(2, -(-bytes_of(book, "v") // block_bytes))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    dealt = book.withColumn("norm", norm).repartitionByRange(blocks, "norm", "code").select(F.spark_partition_id().alias("block"), "norm", "v", "code")
    dealt = materialize(dealt)
    bounds = dealt.groupBy("block").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    given = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fits = F.coalesce(F.size("v") == dim, F.lit(False))
    known = given.filter(fits).select(norm.alias("norm"), "id", "v", F.monotonically_increasing_id().alias("n"))
    least, most = (max(1, b // (8 * dim)) for b in CHUNK_BYTES)
    n = given.filter(fits).count()
    rows = min(max(n // CHUNKS, least), most, rows_per_task)
    known = known.repartitionByRange(max(1, -(-n // rows)), "norm", "n").select(
        F.spark_partition_id().alias("chunk"), "norm", "id", "v", F.lit(None).cast("long").alias("code"), F.lit(float("inf")).alias("dist"))
    known = materialize(known)
    kind = f"chunk int, norm double, id {given.schema['id'].dataType.simpleString()}, v array<double>, code long, dist double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            chunks, codes = b.column("chunk").to_numpy(), b.column("is_code").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((chunks[1:] != chunks[:-1]) | (codes[1:] != codes[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(b)]):
                if hi > lo and (now is None or chunks[lo] != now.number):
                    if now:
                        yield now.rows()
                    now = _Chunk(int(chunks[lo]), dim)
                if hi > lo:
                    (now.meet if codes[lo] else now.add)(b.slice(lo, hi - lo))
        if now:
            yield now.rows()

    def turn(rows: DataFrame, pairs: DataFrame, chunks: int) -> DataFrame:
        """Each chunk's vectors, then the codes of the blocks that it meets, both in the order of their norms."""
        met = dealt.join(pairs, "block").select("chunk", F.lit(True).alias("is_code"), "norm", "v", "code")
        each = rows.withColumn("is_code", F.lit(False)).unionByName(met, allowMissingColumns=True)
        return each.repartition(chunks, "chunk").sortWithinPartitions("chunk", "is_code", "norm").mapInArrow(run, kind)

    chunks = max(1, -(-n // rows))
    own = known.groupBy("chunk").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    first_pairs = own.join(bounds, (F.col("low") <= F.col("b")) & (F.col("high") >= F.col("a"))).select("chunk", "block")
    first = materialize(turn(known, first_pairs, chunks))
    far = F.sqrt("dist") + 1e-9 * (1.0 + F.sqrt("dist") + F.col("norm"))
    reach = first.groupBy("chunk").agg(F.min(F.col("norm") - far).alias("a"), F.max(F.col("norm") + far).alias("b"))
    pairs = reach.join(bounds, (F.col("low") <= F.col("b")) & (F.col("high") >= F.col("a"))).select("chunk", "block").join(first_pairs, ["chunk", "block"], "left_anti")
    best = turn(first, pairs, chunks).select("id", "code", F.when(F.col("code").isNotNull(), F.col("dist")).alias("dist"))
    none = given.filter(~fits).select("id", F.lit(None).cast("long").alias("code"), F.lit(None).cast("double").alias("dist"))
    return best.unionByName(none).select(F.col("id").alias(id_col), F.col("code").alias(code_col), "dist")


class _Chunk:
    """Vectors and the nearest code that each has met."""

    def __init__(self, number: int, dim: int) -> None:
        self.number, self.dim, self.parts, self.x = number, dim, [], None

    def add(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def _stack(self) -> None:
        t = pa.Table.from_batches(self.parts).combine_chunks()
        self.parts, self.ids, self.vectors = [], t.column("id"), t.column("v")
        self.x = valid_matrix(self.vectors, self.dim)[1]
        self.norm, self.dist = (t.column(c).to_numpy().copy() for c in ("norm", "dist"))
        self.code = t.column("code").fill_null(0).to_numpy().copy()

    def meet(self, part: pa.RecordBatch) -> None:
        """Codes in the order of their norms; a vector is scored against those that come as near as its best."""
        if self.x is None:
            self._stack()
        mask, book = valid_matrix(part.column("v"), self.dim)
        if not mask.all():
            raise ValueError(f"the codebook has vectors of a width other than {self.dim}")
        norms, far = part.column("norm").to_numpy(), np.sqrt(self.dist)
        far += 1e-9 * (1.0 + far + self.norm)
        near = np.flatnonzero((self.norm - far <= norms[-1]) & (self.norm + far >= norms[0]))
        if not len(near):
            return
        code, dist = _nearest(self.x[near], part.column("code").to_numpy(), book, (book * book).sum(axis=1))
        better = (dist < self.dist[near]) | ((dist == self.dist[near]) & (code < self.code[near]))
        self.code[near[better]], self.dist[near[better]] = code[better], dist[better]

    def rows(self) -> pa.RecordBatch:
        if self.x is None:
            self._stack()
        one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(self.dist), self.number, dtype=np.int32)), pa.array(self.norm), one(self.ids), one(self.vectors),
                                           pa.array(self.code, mask=np.isinf(self.dist)), pa.array(self.dist)], names=["chunk", "norm", "id", "v", "code", "dist"])


#: Groups that a task adds up before it hands their sums on.
GROUPS = 4096


def vector_sums(df: DataFrame, group, vec_col: str) -> DataFrame:
    """``(*group, sums array<double>, counts array<long>)``: elementwise sums of a group's vectors and of how many it has at each place.

    A task adds vectors up as arrays, a batch at a time, and hands on one row a
    group (or one for each time that ``GROUPS`` groups have gathered); rows of
    one group then come together sorted and are added one by one. So a number is
    never a row of its own, a hot group is combined before the shuffle, and no
    group is held whole. Null vectors and null elements count for nothing.
    """
    g = [group] if isinstance(group, str) else list(group)
    d = df.select(F.to_json(F.struct(*g), {"ignoreNullFields": "false"}).alias("__key"), F.struct(*g).alias("__g"), F.col(vec_col).cast("array<double>").alias("__x"))
    schema = T.StructType([d.schema["__key"], d.schema["__g"], T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    each = d.mapInArrow(_added_up, schema).repartition("__key").sortWithinPartitions("__key")
    return each.mapInArrow(_added_on, schema).select("__g.*", "sums", "counts")


def _matrix_and_mask(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A matrix as wide as the longest list, zero where there is no element; where there is one; the lists' lengths."""
    import pyarrow.compute as pc
    n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    x, there = np.zeros((len(n), int(n.max(initial=0)))), np.zeros((len(n), int(n.max(initial=0))), dtype=np.int64)
    at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    x[at] = np.where(known, flat.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
    there[at] = known
    return x, there, n


def _plus(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    if a is None or not len(a):
        return b
    if len(a) < len(b):
        a, b = b, a
    a = a.copy()
    a[:len(b)] += b
    return a


def _sum_rows(groups: dict) -> pa.RecordBatch:
    keys, structs, sums, counts = zip(*((k, *v) for k, v in groups.items()))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.concat_arrays(structs), pa.array(sums, pa.list_(pa.float64())), pa.array(counts, pa.list_(pa.int64()))],
                                      names=["__key", "__g", "sums", "counts"])


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict = {}
    for b in batches:
        if not b.num_rows:
            continue
        codes = b.column("__key").dictionary_encode()
        of, keys = codes.indices.to_numpy(), codes.dictionary.to_pylist()
        x, there, width = _matrix_and_mask(b.column("__x"))
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(len(keys)))
        x, there = (np.add.reduceat(m[order], starts, axis=0) for m in (x, there))
        width = np.maximum.reduceat(width[order], starts)
        for i, k in enumerate(keys):
            at = int(order[starts[i]])
            one, sums, counts = groups.get(k) or (b.column("__g").slice(at, 1), None, None)
            groups[k] = one, _plus(sums, x[i, :width[i]]), _plus(counts, there[i, :width[i]])
        if len(groups) >= GROUPS:
            yield _sum_rows(groups)
            groups = {}
    if groups:
        yield _sum_rows(groups)


def _added_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, last = {}, None
    for b in batches:
        done = {}
        for i, k in enumerate(b.column("__key").to_pylist()):
            if k != last:
                done |= now
                now, last = {k: (b.column("__g").slice(i, 1), None, None)}, k
            one, sums, counts = now[k]
            now[k] = one, _plus(sums, b.column("sums")[i].values.to_numpy()), _plus(counts, b.column("counts")[i].values.to_numpy())
        if done:
            yield _sum_rows(done)
    if now:
        yield _sum_rows(now)


def pool_mean(df: DataFrame, group, vec_col: str, out: str = "pooled") -> DataFrame:
    """Elementwise mean of a group's vectors (in double), from ``vector_sums``; null where no vector has an element."""
    g = [group] if isinstance(group, str) else list(group)
    mean = F.zip_with("sums", "counts", lambda s, n: F.when(n > 0, s / n))
    return vector_sums(df, g, vec_col).filter(F.size("sums") > 0).select(*g, mean.alias(out))


def pool_first(df: DataFrame, group, vec_col: str, order: str, out: str = "pooled") -> DataFrame:
    """The first vector of each group in ``order`` (``min_by``, partially aggregated)."""
    g = [group] if isinstance(group, str) else list(group)
    return df.groupBy(*g).agg(F.min_by(F.col(vec_col), F.col(order)).alias(out))
