"""Table forms of the sequence operators, for sequences stored one element per row
``(sequence id, position, value)`` (W4, W5).

Windows are partitioned by sequence, so a task holds one sequence at most:
bounded by the sequence length, never by the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import CALM_CODE


def trim_calm_run_table(df: DataFrame, seq: str, pos: str, code: str, calm: int = CALM_CODE,
                        run: int = 8) -> DataFrame:
    """Keep positions before the first calm code that makes a calm run longer
    than ``run`` (gaps and islands: a run is a block of calm positions whose
    ``pos - row_number`` is constant)."""
    is_calm = F.col(code) == calm
    by_kind = Window.partitionBy(seq, is_calm).orderBy(pos)
    # one shuffle by sequence serves all three windows
    d = df.repartition(seq).withColumn("__island", F.col(pos) - F.row_number().over(by_kind))
    in_run = Window.partitionBy(seq, is_calm, "__island").orderBy(pos)
    d = d.withColumn("__run_pos", F.when(is_calm, F.row_number().over(in_run)))
    cut = F.min(F.when(F.col("__run_pos") == run + 1, F.col(pos))).over(Window.partitionBy(seq))
    d = d.withColumn("__cut", cut)
    return d.filter(F.col("__cut").isNull() | (F.col(pos) < F.col("__cut"))).drop("__island", "__run_pos", "__cut")


def position_ids_table(df: DataFrame, seq: str, pos: str, mask: str, out: str = "position_id") -> DataFrame:
    """Running sum of the mask minus one per sequence, and 1 where the mask is 0."""
    w = Window.partitionBy(seq).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(F.col(mask) == 0, F.lit(1)).otherwise(F.sum(mask).over(w) - 1))
