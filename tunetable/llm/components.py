"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """Hook neighbours to the least node around: of smaller neighbours (small) or larger ones.

    ``links`` is (u, v) with u > v. Grouped minima are combined before the
    shuffle; the join back may split a node with very many links.
    """
    if small:
        both = links
    else:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    seen = both if small else both.filter("v > u")
    hooked = seen.join(least, seen["u"] == least["c"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        hooked = hooked.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return hooked.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``links(a, b)``, component the least node reachable.

    Large and small stars in turn (Kiveris et al., 2014) until the links are
    stars; every turn is stored, so a lost executor repeats one turn only.
    """
    now = links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).filter("u <> v").distinct()
    now, mark = stored(now, "links"), None
    while True:
        now = stored(_stars(_stars(now, small=False), small=True), "stars")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
