"""Write a K-times copy of the driver tables for scaling checks (not a correctness input).

    python tools/scale_copy.py /root/testdata/sf0.1 /tmp/run-XXXX/sf1x 10

Ids are offset per copy so keys stay unique; users are not offset, so per-user
groups grow K-fold. Each table is written as 16 files.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ID_COLUMNS = {"documents": ["doc_id"], "labels": ["doc_id"], "events": ["event_id"],
              "embeddings": ["vec_id"], "conversations": ["conv_id"]}
OTHER = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "pages", "benchmark"]


def main() -> None:
    src, dst, k = sys.argv[1].rstrip("/"), sys.argv[2].rstrip("/"), int(sys.argv[3])
    from pyspark.sql import functions as F

    from tunetable.session import build_session
    spark = build_session("local[8]", shuffle_partitions=16)
    for name, ids in ID_COLUMNS.items():
        df = spark.read.parquet(f"{src}/{name}.parquet")
        span = {c: df.agg(F.max(c)).collect()[0][0] + 1 for c in ids}
        out = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        for c in ids:
            out = out.withColumn(c, (F.col(c) + F.col("__k") * span[c]).cast(df.schema[c].dataType))
        out.drop("__k").repartition(16).write.mode("overwrite").parquet(f"{dst}/{name}.parquet")
    for name in OTHER:
        spark.read.parquet(f"{src}/{name}.parquet").write.mode("overwrite").parquet(f"{dst}/{name}.parquet")
    spark.stop()


if __name__ == "__main__":
    main()
