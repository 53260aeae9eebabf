"""Batching and packing.

Global order is never one task: positions come from the ranged and the
two-level index in ``plans.prefix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col_of, idiv, keyed_hash, lit_of
from ..functions.arrays import pad_or_truncate
from ..plans.prefix import ranged_index, ranged_sum, row_index, running_sum


def plan_batches(df: DataFrame, order, batch, micro: int = 1, partition=None, bucket=None) -> DataFrame:
    """Assign ``batch_id``, ``micro_id`` and ``position`` in ``order`` per ``partition``.

    Batches hold ``batch`` rows (a column or an int; the last may be short);
    each batch is split into ``micro`` micro-batches of ``ceil(batch/micro)``
    rows. Positions come from ranges of ``order`` (any keys, sparse or hashed
    too), or from ``bucket``, a column monotone in ``order``.
    """
    order = [order] if isinstance(order, str) else list(order)
    d = row_index(df, order, bucket, partition, out="__idx") if bucket is not None else ranged_index(df, order, partition, out="__idx")
    b = lit_of(batch).cast("long")
    msize = idiv(b + (micro - 1), F.lit(micro))
    pos = F.col("__idx") % b
    return (d.withColumn("batch_id", idiv(F.col("__idx"), b))
            .withColumn("position", pos)
            .withColumn("micro_id", idiv(pos, msize))
            .drop("__idx"))


def pack_blocks(df: DataFrame, tokens: str, order, block: int = 1024, id_col: str = "doc_id",
                bucket=None, n_col=None) -> DataFrame:
    """Treat the corpus as one token stream in ``order`` and cut it into blocks.

    No separator token between documents; the short last block is kept.
    Output: ``block_id, tokens, n_tokens, n_docs, first_doc``.

    The running offset is computed on a narrow ``(id, order, n)`` table (two
    longs per document go through its shuffles, never the token arrays); pass
    ``n_col`` when the token count is cheaper to get than the tokens (it must
    equal ``size(tokens)``). The arrays are then joined to their offsets and
    split at block borders by slicing, so a block group never holds more
    than ``block`` tokens.
    """
    order = [order] if isinstance(order, str) else list(order)
    n = (F.col(n_col) if isinstance(n_col, str) else n_col) if n_col is not None else F.size(tokens)
    lens = df.select(id_col, *[o for o in order if o != id_col], n.cast("long").alias("__n"))
    offs = running_sum(lens, "__n", order, bucket, None, out="__off", inclusive=False) if bucket is not None else \
        ranged_sum(lens, "__n", order, out="__off", inclusive=False)
    offs = offs.select(F.col(id_col).alias("__id"), "__off", "__n")
    d = df.select(id_col, F.col(tokens).alias("__tok")).join(offs, F.col(id_col) == F.col("__id")).drop("__id")
    d = d.filter(F.col("__n") > 0)
    first = idiv(F.col("__off"), F.lit(block))
    last = idiv(F.col("__off") + F.col("__n") - 1, F.lit(block))

    def piece(k):
        start = F.greatest(k * block - F.col("__off"), F.lit(0))
        end = F.least((k + 1) * block - F.col("__off"), F.col("__n"))
        return F.struct(k.alias("block_id"), F.slice("__tok", (start + 1).cast("int"), (end - start).cast("int")).alias("p"))

    # cut inside the row, so each block's row carries its own slice only
    d = d.select(id_col, "__off", F.explode(F.transform(F.sequence(first, last), piece)).alias("__x"))
    d = d.select(id_col, "__off", F.col("__x.block_id").alias("block_id"), F.col("__x.p").alias("__piece"))
    g = d.groupBy("block_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("__off"), F.col(id_col).alias("doc"),
                                             F.col("__piece").alias("p")))).alias("__parts"))
    return g.select(
        "block_id",
        F.flatten(F.transform("__parts", lambda s: s["p"])).alias("tokens"),
        F.aggregate("__parts", F.lit(0).cast("long"), lambda a, s: a + F.size(s["p"])).alias("n_tokens"),
        F.size("__parts").alias("n_docs"),
        F.col("__parts")[0]["doc"].alias("first_doc"))


def corpus_budget(df: DataFrame, n_tokens: str, block: int = 1024, batch: int = 8) -> DataFrame:
    """Total tokens, blocks = ceil(total / block), train and eval (2x) batch sizes."""
    tot = F.sum(col_of(n_tokens).cast("long"))
    return df.agg(tot.alias("total_tokens")).select(
        "total_tokens", F.lit(block).alias("block"),
        idiv(F.col("total_tokens") + (block - 1), F.lit(block)).alias("n_blocks"),
        F.lit(batch).alias("batch_train"), F.lit(2 * batch).alias("batch_eval"))


def step_plan(df: DataFrame, limits: DataFrame, phase: str = "phase", accumulate: int = 4,
              max_steps: int = 500) -> DataFrame:
    """Per phase: examples, batch, accumulation, effective batch, steps per epoch, epochs covered."""
    counts = df.groupBy(F.col(phase).alias("phase")).agg(F.count(F.lit(1)).alias("n_examples"))
    j = counts.join(limits.select("phase", "batch"), "phase")
    eff = F.col("batch") * accumulate
    return j.select(
        "phase", "n_examples", "batch", F.lit(accumulate).alias("accumulate"),
        eff.alias("effective_batch"),
        idiv(F.col("n_examples") + eff - 1, eff).alias("steps_per_epoch"),
        (F.lit(max_steps) * eff / F.col("n_examples")).alias("epochs_covered"))


def select_text_field(df: DataFrame, field: str = "prompt", out: str = "text", keep=()) -> DataFrame:
    """The trainer consumes one named text column (P4); ``keep`` carries id columns along."""
    return df.select(*keep, F.col(field).alias(out))


def collate_causal(df: DataFrame, batch_col: str, tokens: str, pad: int = 0,
                   ignore: int = -100, partition=()) -> DataFrame:
    """Pad each batch to its longest sequence; labels are the inputs with pad positions ``ignore``.

    Batches are told apart by ``partition`` (the columns ``plan_batches`` counted
    them in) and ``batch_col``; a window is bounded by the batch size.
    """
    n = F.size(col_of(tokens))
    d = df.withColumn("__len", n).withColumn(
        "padded_len", F.max("__len").over(Window.partitionBy(*partition, batch_col)))
    ids = pad_or_truncate(tokens, F.col("padded_len"), pad)
    d = d.withColumn("input_ids", ids)
    d = d.withColumn("attention_mask", F.transform("input_ids", lambda x, i: F.when(i < F.col("__len"), 1).otherwise(0)))
    d = d.withColumn("labels", F.transform("input_ids", lambda x, i: F.when(i < F.col("__len"), x).otherwise(F.lit(ignore))))
    return d.drop("__len")


def seeded_shuffle(df: DataFrame, key: str, seed: int, bits: int = 16, out: str = "shuffle_pos") -> DataFrame:
    """Reproducible permutation: position of each row in ``(keyed_hash(seed, key), key)`` order.

    The hash is uniform over 60 bits, so its top ``bits`` split the rows into
    2**bits equal cells: each cell is one bounded window, and the cell table
    (2**bits rows) is the only global step.
    """
    d = df.withColumn("__h", keyed_hash(seed, key))
    return row_index(d, ["__h", key], F.shiftright("__h", 60 - bits), None, out=out).drop("__h")
