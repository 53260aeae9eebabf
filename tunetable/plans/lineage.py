"""Materialising a result that several branches of a plan consume.

Spark re-evaluates a DataFrame in every branch that uses it unless an
exchange can be reused. After expensive per-row Python work (tokenising),
the narrow result is checkpointed once to the shared checkpoint folder: a
reliable copy that survives lost executors and cuts the lineage, so no
branch repeats the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import shared_dir


def materialize(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)  # the cluster's spark.checkpoint.dir (a private one only when unset)
    return df.checkpoint(eager=True)
