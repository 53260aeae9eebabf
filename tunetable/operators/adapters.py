"""Low-rank adapters as tables: merge (J6), apply (J8), fit (X3), 4-bit blocks.

One adapter's matrices have a size fixed by the configuration (r x (in + out)
per targeted matrix), never by the data. Many adapters are a table like any
other and meet their rows by joins and shuffles.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keyed_hash
from ..plans.files import listed, present, removed, whole
from ..plans.joins import matrix_of
from ..plans.meeting import ROWS_PER_TASK, per_model
from ..session import scratch_path

# ---------------------------------------------------------------- merge


def merge_adapter(base: DataFrame, adapters: DataFrame, alpha: float, r: int,
                  fan_in_fan_out: bool = False) -> DataFrame:
    """W' = W + (alpha / r) * B A on targeted tensors; other tensors unchanged.

    ``base``: one row per matrix row ``(tensor, row, values)``.
    ``adapters``: one row per targeted tensor ``(tensor, lora_A, lora_B)``
    with A as r rows of ``in`` and B as ``out`` rows of r. With
    ``fan_in_fan_out`` the base is stored transposed (rows are inputs) and
    the delta is transposed to match.

    A stored row needs r numbers of its own (its row of B, or its column of A)
    and the r vectors along the row. The first are cut out per row and joined
    on ``(tensor, row)``; the second are joined as r rows per tensor, one
    ``zip_with`` for each of the r terms. A row without its r numbers (a null
    or out-of-range ``row``) keeps its values.
    """
    scale = float(alpha) / float(r)
    ranks = range(r)
    if fan_in_fan_out:  # row i of the store is column i of A; along the row run B's columns
        own = F.transform(F.sequence(F.lit(0), F.size(F.col("lora_A")[0]) - 1),
                          lambda i: F.array(*(F.get(F.col("lora_A")[j], i) for j in ranks)))
        along = F.transform(F.sequence(F.lit(0), F.lit(r - 1)), lambda j: F.transform("lora_B", lambda row: F.get(row, j)))
    else:
        own, along = F.col("lora_B"), F.col("lora_A")
    per_row = adapters.select("tensor", F.posexplode(own).alias("row", "__own"))
    per_tensor = adapters.select("tensor", along.alias("__along"))
    d = base.withColumn("values", F.transform("values", lambda w: w.cast("double")))
    d = d.join(per_row, ["tensor", "row"], "left").join(per_tensor, "tensor", "left")
    delta = F.transform("__along", lambda v, j: F.transform(v, lambda x: x.cast("double") * F.get(F.col("__own"), j)))
    total = F.aggregate(F.slice(delta, 2, r), F.get(delta, F.lit(0)), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    merged = F.zip_with("values", total, lambda w, x: w + F.lit(scale) * x)
    d = d.withColumn("values", F.when(F.col("__own").isNull(), F.col("values")).otherwise(merged))
    return d.select(*base.columns)


# ---------------------------------------------------------------- apply


def apply_adapter(vectors: DataFrame, base: DataFrame, adapters: DataFrame, alpha: float, r: int,
                  id_col: str = "vec_id", vec_col: str = "embedding", adapter_col: str = "adapter_id",
                  max_bytes: int = 1 << 30, rows_per_task: int = ROWS_PER_TASK, salts: int = 4096) -> DataFrame:
    """y = W x + (alpha / r) * B (A x), with the adapter chosen per row.

    ``base``: ``(row, values)`` rows of W (out x in), one model matrix of
    checked size. ``adapters``: ``(adapter_id, lora_A, lora_B)``, any number of
    them: vectors and adapters meet by a shuffle on the adapter (``plans.meeting``).
    An adapter travels once, and more often (at most ``salts`` times) only if it
    has more than ``rows_per_task`` vectors; a task holds one adapter and one
    Arrow batch at a time. Ids are compared as text; a row whose id is null or names no adapter
    gets a null output, never the base output.
    """
    _rows, W = matrix_of(base, max_bytes)
    scale = float(alpha) / float(r)
    bc = vectors.sparkSession.sparkContext.broadcast(W)
    id_type = vectors.schema[id_col].dataType.simpleString()
    matrix = "array<array<double>>"
    models = adapters.select(adapter_col, F.col("lora_A").cast(matrix).alias("a"), F.col("lora_B").cast(matrix).alias("b"))
    rows = vectors.select(adapter_col, F.col(id_col).alias("id"), F.col(vec_col).alias("x"))

    def load(_shared, m):
        return tuple(np.array(m[c].as_py(), dtype=np.float64) for c in "ab")

    def score(_shared, model, part: pa.RecordBatch) -> pa.RecordBatch:
        from .codes import valid_matrix
        W = bc.value
        n, k = part.num_rows, W.shape[0]
        known, X = valid_matrix(part.column("x"), W.shape[1])
        out = np.zeros((n, k))
        if model is None:
            known = np.zeros(n, dtype=bool)
        elif known.any():
            A, B = model
            out[known] = X @ W.T + scale * ((X @ A.T) @ B.T)
        off = (np.arange(n + 1) * k).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [part.column("id"), pa.ListArray.from_arrays(pa.array(off), pa.array(out.ravel()), mask=pa.array(~known))],
            names=[id_col, "output"])

    return per_model(models, rows, adapter_col, load, score, f"{id_col} {id_type}, output array<double>", rows_per_task, salts=salts)


def stack_adapter(tensors: DataFrame, matrix_col: str = "tensor", by=("adapter_id",)) -> DataFrame:
    """Adapter tables ``(matrix 'A' / 'B', row, values)`` as ``lora_A`` and ``lora_B``, one row per adapter:
    what ``fit_adapter`` returns and ``read_adapter`` loads, in the form that ``apply_adapter`` takes."""
    one = lambda m: F.transform(F.sort_array(F.collect_list(  # noqa: E731  (at most r + k rows an adapter)
        F.when(F.col(matrix_col) == m, F.struct("row", "values")))), lambda s: s["values"])
    return tensors.groupBy(*by).agg(one("A").alias("lora_A"), one("B").alias("lora_B"))


# ---------------------------------------------------------------- fit


def _softmax_grads(X, y, W, A, B, scale, k):
    Z = X @ W.T + scale * ((X @ A.T) @ B.T)
    Z = Z - Z.max(axis=1, keepdims=True)
    P = np.exp(Z)
    P /= P.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(P[np.arange(len(y)), y], 1e-300)).sum()
    G = P.copy()
    G[np.arange(len(y)), y] -= 1.0
    H = X @ A.T                      # n x r
    gB = scale * (G.T @ H)           # k x r
    gA = scale * ((G @ B).T @ X)     # r x d
    return loss, gA, gB


def fit_adapter(spark: SparkSession, data: DataFrame, base: DataFrame, r: int = 4, alpha: float = 8.0,
                lr: float = 0.5, steps: int = 20, seed: int = 0, vec_col: str = "embedding",
                label_col: str = "label", batch: int | None = None, path: str | None = None, every: int = 1,
                keep: int = 2, init: np.ndarray | None = None, max_bytes: int = 1 << 30) -> tuple[DataFrame, DataFrame]:
    """Train A (r x d) and B (k x r, zero start) over a frozen base W (k x d) with
    softmax cross-entropy and gradient descent, on all rows or on mini-batches.

    The usable examples are stored once in shared storage. With ``batch``, every
    epoch deals them anew into ceil(n / batch) mini-batches by a hash of row and
    epoch (their sizes vary around ``batch``; equal rows stay together), written
    as shards: a step reads the files of its own shard and no others. Rows of
    unknown label or another width can't train; the loss table counts the rows
    of each step.

    Each step is one distributed job: A, B and W go to the tasks, every
    partition makes one array of its partial loss and gradients (r * (d + k)
    numbers), square-root-many tasks add these, and the driver adds their
    sums for the update.

    With ``path`` the fit can be resumed: examples, shards and, after each
    ``every`` steps, the state (step, A, B, losses) are kept there, of the states
    the last ``keep``. A call with the same path and settings goes on after the
    last whole state and gives what an unbroken run gives; other settings raise.
    Returns (adapter table, loss per step).
    """
    names, W = matrix_of(base, max_bytes)
    k, d = W.shape
    A = np.random.default_rng(seed).normal(0.0, 0.01, size=(r, d)) if init is None else np.array(init, dtype=np.float64)
    B = np.zeros((k, r))
    scale = float(alpha) / float(r)
    home = path or scratch_path(spark, "fit")
    settings = json.dumps({"r": r, "alpha": alpha, "lr": lr, "seed": seed, "batch": batch, "base": hashlib.sha256(W.tobytes()).hexdigest(), "start": hashlib.sha256(A.tobytes()).hexdigest()}, sort_keys=True)
    first, losses = 0, []
    state = fit_state(spark, path) if path else None
    if state:
        if state["settings"] != settings:
            raise ValueError(f"{path} holds a fit with other settings: {state['settings']}")
        first, losses = state["step"] + 1, [tuple(x) for x in state["losses"]]
        A, B = (np.array(state[m], dtype=np.float64).reshape(shape) for m, shape in (("a", (r, d)), ("b", (k, r))))

    examples = f"{home}/examples"
    if not whole(spark, examples):
        # an example needs a vector of the base width and a label that a base row has
        place = spark.createDataFrame([(int(x), i) for i, x in enumerate(names)], "__label int, y int")  # as many rows as the checked base
        known = data.select(F.col(vec_col).alias("x"), F.col(label_col).cast("int").alias("__label")).filter(F.size("x") == d)
        known.join(F.broadcast(place), "__label").select("x", "y", F.monotonically_increasing_id().alias("n")).write.mode("overwrite").parquet(examples)
    src = spark.read.parquet(examples)
    n_total = src.count()
    if n_total == 0:
        raise ValueError("no usable training examples")
    turns = -(-n_total // batch) if batch else 1
    size = r * d + k * r
    sc = spark.sparkContext
    merging = max(1, int(sc.defaultParallelism ** 0.5))
    for step in range(first, steps):
        epoch, turn = divmod(step, turns)
        rows = src if turns == 1 else _shard(src, home, seed, epoch, turn, turns, n_total)
        bc = sc.broadcast((W, A, B))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            W_, A_, B_ = bc.value
            acc = np.zeros(size + 2)
            for b in batches:
                if len(b) == 0:
                    continue
                X = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)
                yv = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                loss, gA, gB = _softmax_grads(X, yv, W_, A_, B_, scale, k)
                acc[:r * d] += gA.ravel()
                acc[r * d:size] += gB.ravel()
                acc[size:] += loss, len(b)
            yield _one_array(acc)

        parts = rows.select("x", "y").mapInArrow(part, "g array<double>")
        g = sum((np.asarray(x["g"]) for x in parts.repartition(merging).mapInArrow(_added, "g array<double>").collect()), np.zeros(size + 2))
        bc.unpersist()
        n = g[size + 1]
        losses.append((step, float(g[size] / n) if n else None, int(n)))
        if n:
            A = A - lr * g[:r * d].reshape(r, d) / n
            B = B - lr * g[r * d:size].reshape(k, r) / n
        if path and ((step + 1) % every == 0 or step + 1 == steps):
            _save_state(spark, path, step, A, B, losses, settings, keep)
    if not path:
        removed(spark, home)
    return adapter_tensors(spark, A, B), spark.createDataFrame(losses, "step int, loss double, n_rows long")


def adapter_tensors(spark: SparkSession, A, B) -> DataFrame:
    """``(matrix 'A' / 'B', row, values)``."""
    return spark.createDataFrame([(m, i, [float(v) for v in row]) for m, x in (("A", A), ("B", B)) for i, row in enumerate(x)],
                                 "matrix string, row int, values array<double>")


#: Folders of an epoch's shards at most, and rows of one of their files.
_FOLDERS, _FILE_ROWS = 1000, 1 << 20


def _shard(src: DataFrame, home: str, seed: int, epoch: int, turn: int, turns: int, n_total: int) -> DataFrame:
    """The examples of one mini-batch, from the epoch's shards (written when the epoch begins; the epoch before goes)."""
    spark, path = src.sparkSession, f"{home}/epoch-{epoch}"
    span = -(-turns // _FOLDERS)
    if not whole(spark, path):
        files = max(1, n_total * span // turns // _FILE_ROWS)
        dealt = src.withColumn("turn", F.pmod(keyed_hash(seed, F.lit(epoch), F.xxhash64("x", "y")), F.lit(turns)).cast("int"))
        dealt = dealt.withColumns({"folder": F.floor(F.col("turn") / span).cast("int"), "__file": F.pmod("n", F.lit(files))})
        dealt = dealt.repartition("folder", "__file").sortWithinPartitions("folder", "turn").drop("__file")
        dealt.write.mode("overwrite").partitionBy("folder").parquet(path)
        removed(spark, f"{home}/epoch-{epoch - 1}")
    return spark.read.schema("x " + src.schema["x"].dataType.simpleString() + ", y int, turn int").parquet(path + f"/folder={turn // span}").filter(F.col("turn") == turn) \
        if present(spark, path + f"/folder={turn // span}") else src.limit(0)


_STATE = "step int, a array<array<double>>, b array<array<double>>, losses array<struct<step:int,loss:double,n_rows:long>>, settings string"


def _save_state(spark: SparkSession, path: str, step: int, A, B, losses: list, settings: str, keep: int) -> None:
    row = [(step, A.tolist(), B.tolist(), losses, settings)]
    spark.createDataFrame(row, _STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/state/step-{step}")
    for old in saved_steps(spark, path)[:-keep]:
        removed(spark, f"{path}/state/step-{old}")


def saved_steps(spark: SparkSession, path: str) -> list[int]:
    """The steps whose state is whole, in order."""
    steps = (n.removeprefix("step-") for n in listed(spark, f"{path}/state"))
    return sorted(int(n) for n in steps if n.isdigit() and whole(spark, f"{path}/state/step-{n}"))


def fit_state(spark: SparkSession, path: str, step: int | None = None) -> dict | None:
    """The state after ``step`` (default: the last whole one), None if there is none."""
    steps = saved_steps(spark, path)
    if not steps or (step is not None and step not in steps):
        return None
    return spark.read.schema(_STATE).parquet(f"{path}/state/step-{steps[-1] if step is None else step}").first().asDict()


def _one_array(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))], names=["g"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all arrays of a partition; no row for an empty one."""
    total = None
    for b in batches:
        for x in b.column(0):
            v = x.values.to_numpy(zero_copy_only=False)
            total = v.copy() if total is None else total + v
    if total is not None:
        yield _one_array(total)


# ---------------------------------------------------------------- 4-bit blocks

# The 16 NormalFloat-4 levels published with QLoRA.
NF4_LEVELS = np.array([
    -1.0, -0.6961928009986877, -0.5250730514526367, -0.39491748809814453,
    -0.28444138169288635, -0.18477343022823334, -0.09105003625154495, 0.0,
    0.07958029955625534, 0.16093020141124725, 0.24611230194568634, 0.33791524171829224,
    0.44070982933044434, 0.5626170039176941, 0.7229568362236023, 1.0])
NF4_MAX_GAP = float(np.max(np.diff(NF4_LEVELS)))
_NF4_MID = (NF4_LEVELS[1:] + NF4_LEVELS[:-1]) / 2


def _blocks(list_arr, block):
    if isinstance(list_arr, pa.ChunkedArray):
        list_arr = list_arr.combine_chunks()
    off = list_arr.offsets.to_numpy().astype(np.int64)
    off = off - off[0]  # a sliced array's values start at its first offset
    vals = list_arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(off)
    nblk = (lengths + block - 1) // block
    blk_off = np.concatenate([[0], np.cumsum(nblk)])
    row_of = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(len(vals)) - np.repeat(off[:-1], lengths)
    blk = blk_off[:-1][row_of] + pos // block
    return off, vals, lengths, nblk, blk_off, blk


def quantise_blocks(arr, block: int = 64):
    """Column of ``struct<codes array<tinyint>, scale_codes array<smallint>, scale_max double>``.

    A null array stays null. Each block of ``block`` values keeps its absmax as scale and one 4-bit
    NF4 level per value; the scales are themselves quantised to 8 bits
    against the row's largest scale (double quantisation).
    """
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            off, vals, lengths, nblk, blk_off, blk = _blocks(a, block)
            nb = int(blk_off[-1])
            absmax = np.zeros(nb)
            np.maximum.at(absmax, blk, np.abs(vals))
            normed = vals / np.where(absmax[blk] > 0, absmax[blk], 1.0)
            # nearest level by binary search over the midpoints (O(n) memory; an
            # exact midpoint goes to the lower level, as argmin would)
            codes = np.searchsorted(_NF4_MID, normed, side="left").astype(np.int8)
            row_blk = np.repeat(np.arange(len(lengths)), nblk)
            smax = np.zeros(len(lengths))
            np.maximum.at(smax, row_blk, absmax) if nb else None
            sq = np.rint(255.0 * absmax / np.where(smax[row_blk] > 0, smax[row_blk], 1.0)).astype(np.int16)
            gone = a.is_null() if not isinstance(a, pa.ChunkedArray) else a.combine_chunks().is_null()
            codes_arr = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(codes, pa.int8()))
            sc_arr = pa.ListArray.from_arrays(pa.array(blk_off.astype(np.int32)), pa.array(sq, pa.int16()))
            yield pa.StructArray.from_arrays([codes_arr, sc_arr, pa.array(smax)],
                                             names=["codes", "scale_codes", "scale_max"], mask=gone)

    udf = F.arrow_udf(run, "struct<codes:array<tinyint>,scale_codes:array<smallint>,scale_max:double>")
    return udf(F.col(arr) if isinstance(arr, str) else arr)


def dequantise_blocks(q, block: int = 64):
    """Inverse of ``quantise_blocks``: ``array<double>``."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in batches:
            if isinstance(s, pa.ChunkedArray):
                s = s.combine_chunks()
            codes = s.field("codes")
            scs = s.field("scale_codes")
            smax = s.field("scale_max").to_numpy(zero_copy_only=False)
            off, cvals, lengths, nblk, blk_off, blk = _blocks(codes, block)
            svals = scs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row_blk = np.repeat(np.arange(len(lengths)), nblk)
            scale = svals / 255.0 * smax[row_blk]
            out = NF4_LEVELS[cvals.astype(np.int64)] * scale[blk]
            yield pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(out), mask=s.is_null())

    udf = F.arrow_udf(run, "array<double>")
    return udf(F.col(q) if isinstance(q, str) else q)
