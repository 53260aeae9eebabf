"""Per-task shuffle input for a hot key: a plain per-key window versus the
two-level index (also on an input stored hash-partitioned by the hot key) and
the candidate lookup. Runs in its own process with Spark's event log written
to a scratch folder; prints the largest number of shuffle records any one task
of the measured jobs read."""

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, sys.argv[1])

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tunetable.plans.prefix import int_bucket, row_index  # noqa: E402
from tunetable.session import build_session  # noqa: E402

mode = sys.argv[2]
logdir = tempfile.mkdtemp(prefix="tt-eventlog-")
spark = build_session("local[4]", app=f"skew-{mode}", shuffle_partitions=64,
                      extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir,
                             "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
                             "spark.sql.adaptive.coalescePartitions.enabled": "false",
                             "spark.sql.adaptive.enabled": "false"})
N = 600_000
df = spark.range(N).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500 + 1).alias("k"))
if mode == "plain":
    out = df.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1)
elif mode == "two_level":
    out = row_index(df, ["id"], int_bucket("id", 2048), ["k"], out="i")
elif mode == "two_level_prepartitioned":
    # input stored hash-partitioned by the hot key (a checkpoint keeps that
    # partitioning, which a window keyed on k alone would happily reuse)
    from tunetable.session import shared_dir
    shared_dir(spark)
    stored = df.repartition("k").checkpoint()
    out = row_index(stored, ["id"], int_bucket("id", 2048), ["k"], out="i")
else:  # conditioning candidates
    from tunetable.operators.manifest import conditioning_candidates
    out = conditioning_candidates(df, "k", "id", 3, width=2048, chunk=2048)
spark.sparkContext.setJobGroup("operator", "measured")  # only these jobs' stages are counted
out.write.format("noop").mode("overwrite").save()
spark.stop()
per_stage, ours = {}, set()
for path in glob.glob(logdir + "/**/*", recursive=True):
    if os.path.isdir(path):
        continue
    with open(path) as f:
        for line in f:
            ev = json.loads(line)
            if ev.get("Event") == "SparkListenerJobStart":
                if (ev.get("Properties") or {}).get("spark.jobGroup.id") == "operator":
                    ours.update(ev.get("Stage IDs", []))
            elif ev.get("Event") == "SparkListenerTaskEnd":
                m = ev.get("Task Metrics") or {}
                r = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                sid = ev.get("Stage ID")
                per_stage[sid] = max(per_stage.get(sid, 0), r)
stages = [per_stage[k] for k in sorted(per_stage) if k in ours and per_stage[k] > 0]
print("max_task_records", max(stages) if stages else 0, N, "stages", stages)
