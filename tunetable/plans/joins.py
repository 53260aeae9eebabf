"""Small tables: constants with a size the planner knows, and model parameters of checked size.

Nothing is broadcast by a row count. A constant table is part of the plan, so
Catalyst knows its bytes; derived tables are left to AQE, which measures them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def constant_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A literal configuration table: its rows are literals of the plan, so the
    planner knows at once that it is small."""
    target = spark.createDataFrame([], schema).schema
    literal = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, target.fields))) for r in rows))
    return spark.range(1).select(F.explode(literal).alias("r")).select("r.*")


def bytes_of(df: DataFrame, vec_col: str) -> int:
    """Bytes of a column of vectors as doubles, from the widths alone."""
    return df.agg(F.sum(F.size(vec_col).cast("long") * 8)).first()[0] or 0


def matrix_of(df: DataFrame, max_bytes: int, key: str = "row", values: str = "values") -> tuple[np.ndarray, np.ndarray]:
    """A model's matrix ``(key, values)`` on the driver, rows in key order, after proving its bytes."""
    size = bytes_of(df, values)
    if size > max_bytes:
        raise ValueError(f"the matrix has {size} bytes, more than the {max_bytes} that a task may hold")
    rows = df.select(F.col(key).alias("k"), F.col(values).alias("v")).filter("v IS NOT NULL").orderBy("k").collect()
    if not rows:
        raise ValueError("the matrix is empty")
    return np.array([x["k"] for x in rows]), np.array([x["v"] for x in rows], dtype=np.float64)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over the cluster's cores where the input has fewer splits than that (a file
    of one row group); the rows are the same, and larger tables are left as they are."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= want else df.repartition(want)
