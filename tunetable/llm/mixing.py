"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources sorted by code point (null last) weigh 5, 2, 1, repeating, and share
150 % of all sizes; no target exceeds twice its source's size, and the excess
is shared again by weight (the level at which that ends is found directly from
the sources' ratios of limit to weight). Each target is first met with
complete epochs of the source; the rest is a draw without replacement in order
of the key ``-ln(u) / w``, u from a hash of id and text, w the document's
quality weight: the first documents whose sizes add up to the rest, the one
across the border if at least half of it fits.

Prefix sums never gather a source in a task: keys fall into ``_CELLS`` ranges
of the key's distribution; ranges are summed before the shuffle, and only the
range across the border of its source is sorted row by row. What remains is one
row per source with the last drawn key, against which each document decides for
itself.

Defined cases: null text has size 0; null ids take part like others; rows
equal in id and text have equal keys and share a fate; a source of size 0 has
target 0; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: By the source's place, repeating.
WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2
_CELLS = 8192
_SEED = 7


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of characters other than blanks that aren't marks of junk."""
    solid = F.greatest(F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]")), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - F.regexp_count(text, F.lit(r"[#*$%&|<>!\d]")) / solid), F.lit(0.1))


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size)`` with ``target``: as water in vessels, whose level rises until the share is poured."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("double"))
    s = s.withColumns({"limit": F.col("source_size") * F.lit(float(LIMIT)), "ratio": F.col("source_size") * F.lit(float(LIMIT)) / F.col("weight")})
    poured = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, here_on = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(poured) * F.lit(SHARE) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(here_on))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("turn", "level"))).over(poured)
    s = s.withColumn("turn", F.row_number().over(rising)).withColumn("full", first["level"])
    return s.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("full") * F.col("weight"), F.col("limit"))).alias("target"))


def _keyed(id_col: str, text_col: str) -> dict[str, Column]:
    text, mark = F.col(text_col), F.xxhash64(F.lit(_SEED), id_col, text_col)
    u = (F.shiftrightunsigned(mark, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    key = -F.log(u) / quality_weight(text)
    return {"__size": size_of(text), "__key": key, "__mark": mark, "__cell": F.floor((1 - F.exp(-key)) * _CELLS).cast("int")}


def plan(rows: DataFrame) -> DataFrame:
    """One row per source: its target, complete epochs and the last key that is drawn; ``rows`` as ``_keyed`` makes them, with ``__source``."""
    cells = stored(rows.groupBy("__source", "__cell").agg(F.sum("__size").alias("cell_size")), "mix-cells")
    wanted = targets(cells.groupBy(F.col("__source").alias("source")).agg(F.sum("cell_size").alias("source_size")))
    wanted = wanted.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    wanted = stored(wanted.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    up_to = Window.partitionBy("__source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(up_to), F.lit(0)))
    border = placed.join(wanted, placed["__source"].eqNullSafe(wanted["source"])).filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("cell_size") >= F.col("rest")))
    border = border.select("source", F.col("__cell").alias("cell"), "before", "rest")
    near = rows.join(border, rows["__source"].eqNullSafe(border["source"]) & (rows["__cell"] == border["cell"]))
    order = Window.partitionBy("source").orderBy("__key", "__mark").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("start", F.col("before") + F.coalesce(F.sum("__size").over(order), F.lit(0)))
    last = near.groupBy("source", "cell").agg(F.max(F.when(F.col("start") + F.col("__size") / 2 <= F.col("rest"), F.struct("__key", "__mark"))).alias("last"))
    last = last.select(F.col("source").alias("__s"), "cell", F.col("last.__key").alias("last_key"), F.col("last.__mark").alias("last_mark"))
    out = wanted.join(last, wanted["source"].eqNullSafe(last["__s"]), "left").drop("__s")
    return stored(out.withColumnsRenamed({c: f"__{c}" for c in out.columns}).withColumnRenamed("__source", "__of"), "mix-plan")


def _epochs() -> Column:
    """Complete epochs, and one more for a key up to the last drawn; without a border every key or none is drawn."""
    same = (F.col("__key") < F.col("__last_key")) | ((F.col("__key") == F.col("__last_key")) & (F.col("__mark") <= F.col("__last_mark")))
    drawn = F.when(F.col("__cell_1").isNull(), F.col("__rest") > 0).otherwise((F.col("__cell") < F.col("__cell_1")) | ((F.col("__cell") == F.col("__cell_1")) & F.coalesce(same, F.lit(False))))
    return F.col("__whole") + drawn.cast("long")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: ``doc_id, source, size, source_size, target, epochs`` (how often the mix takes the whole document), ``taken``."""
    rows = stored(docs.withColumns(_keyed(id_col, text_col)).select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("__source"), "__size", "__key", "__mark", "__cell"), "mix-rows")
    p = plan(rows).withColumnRenamed("__cell", "__cell_1")
    out = rows.join(p, rows["__source"].eqNullSafe(p["__of"])).withColumn("epochs", _epochs())
    return out.select("doc_id", F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), "epochs", (F.col("epochs") * F.col("__size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix with their columns, each as often as it is taken. Texts aren't shuffled: each row meets its source's plan."""
    keyed = docs.withColumns(_keyed(id_col, text_col))
    rows = stored(keyed.select(F.col(source_col).alias("__source"), "__size", "__key", "__mark", "__cell"), "mix-rows")
    p = plan(rows).withColumnRenamed("__cell", "__cell_1")
    out = keyed.join(p, keyed[source_col].eqNullSafe(p["__of"])).withColumn("__epochs", _epochs().cast("int")).filter("__epochs > 0")
    return out.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__epochs")))).select(*(docs[c] for c in docs.columns))
