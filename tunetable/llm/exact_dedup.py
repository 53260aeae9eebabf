"""Exact duplicates through an extendible-hash index on shared files.

One pass over the texts writes a narrow row per document (address, SHA-256,
bytes) to the shared folder. Rows of equal address and SHA-256 become one
index entry, combined before the shuffle, so a group of copies of any size
costs one entry a task. The directory starts at depth 0 and doubles: a bucket
with more than ``capacity`` entries is split by the next bit of its address
until it fits, so buckets have depths of their own. Entries are written to the
shared folder by bucket, each bucket by the task that owns it. Entries of one
address form a chain; where a chain speaks for several rows, their texts are
compared byte by byte, as the grouping key of whole texts. Everything is
DataFrame work; nothing is collected.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` becomes
one space. The row with the smallest id stays.

Defined cases: null text counts as empty; null ids come after all others; of
rows that share the smallest id one stays; different texts of one address
stay apart; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

_RUNS = r"[\x20\x09-\x0D]+"


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def _address(text: Column, bits: int) -> Column:
    """The upper ``bits`` bits of the text's hash (fewer than 64 only in tests, to force chains)."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits) if bits < 64 else F.xxhash64(text)


def _cell(address: Column, bits: int, depth: int) -> Column:
    return F.shiftrightunsigned(address, max(bits - depth, 0)) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int, bits: int = 64) -> DataFrame:
    """``(cell, depth, bucket)``: for each address prefix the depth and number of its bucket.

    A bucket's depth is the smallest at which its prefix holds at most
    ``capacity`` entries. Counts of the finest cells, some 256 a bucket, are
    added up level by level.
    """
    n = entries.count()
    finest = min(bits, max(0, math.ceil(math.log2(max(n, 1) / capacity))) + 8)
    cells = entries.groupBy(_cell(F.col("address"), bits, finest).alias("cell")).agg(F.count("*").alias("n"))
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("depth"))
    levels = levels.withColumn("bucket", F.expr(f"shiftrightunsigned(cell, {finest} - depth)"))
    totals = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("total"))
    fits = levels.join(totals, ["depth", "bucket"]).filter((F.col("total") <= capacity) | (F.col("depth") == finest))
    found = fits.groupBy("cell").agg(F.min("depth").alias("depth"))
    return found.select("cell", "depth", F.expr(f"concat_ws('-', depth, shiftrightunsigned(cell, {finest} - depth))").alias("bucket"), F.lit(finest).alias("finest"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 15, bits: int = 64) -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256, bucket``."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normal(F.col(text_col)).alias("norm"))
    keyed = norm.withColumns({"address": _address(F.col("norm"), bits), "sha": F.sha2("norm", 256)})
    rows = stored(keyed.select("doc_id", "address", F.unhex("sha").alias("sha"), F.monotonically_increasing_id().alias("row")), "exact-rows")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    entries = stored(rows.groupBy("address", "sha").agg(first.alias("head"), F.count("*").alias("group_size")), "exact-entries")

    places = directory(entries, capacity, bits)
    finest = places.select("finest").first()
    cell = _cell(F.col("address"), bits, finest[0] if finest else 0)
    placed = entries.withColumn("cell", cell).join(places.select("cell", "bucket"), "cell").drop("cell")
    index = stored(placed.repartition("bucket"), "exact-index", ("bucket",))

    chained = index.groupBy("address").agg(F.sum("group_size").alias("n")).filter("n > 1").select("address")
    ids = rows.join(chained, "address", "left_semi").select("doc_id").distinct()
    texts = keyed.join(ids, keyed["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    compared = texts.groupBy("address", "sha", "norm").agg(F.count("*").alias("n")).groupBy("address", F.unhex("sha").alias("sha")).agg(F.count("*").alias("texts"))
    checked = index.join(compared, ["address", "sha"], "left").withColumn(
        "group_size", F.when(F.coalesce("texts", F.lit(1)) == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("texts of equal SHA-256 differ"))))
    out = rows.join(stored(checked, "exact-checked"), ["address", "sha"])  # a plain join, of which Spark can split a hot group
    return out.select("doc_id", F.col("head.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("head.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    groups = exact_groups(docs, id_col, text_col, **settings)
    stay = groups.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    keyed = docs.withColumn("__key", F.sha2(normal(F.col(text_col)), 256))
    kept = keyed.join(stay, keyed["__key"].eqNullSafe(stay["__sha"]) & keyed[id_col].eqNullSafe(stay["__id"]))
    same = Window.partitionBy(id_col, "__key").orderBy("__key")
    return kept.withColumn("__n", F.row_number().over(same)).filter("__n = 1").select(*(docs[c] for c in docs.columns))
