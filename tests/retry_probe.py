"""Run operators with a task failure injected into the first attempt of every
input partition and print a digest; used by test_retries.py in its own process
(task retries need master local[n, maxFailures])."""

import hashlib
import sys
import tempfile

sys.path.insert(0, sys.argv[1])

from pyspark import TaskContext  # noqa: E402

from tunetable import standins as S  # noqa: E402
from tunetable.operators import batching, decoding as DE, manifest as MA  # noqa: E402
from tunetable.session import build_session, ship_package  # noqa: E402

inject = sys.argv[2] == "fail"
spark = build_session("local[2,4]", app="retry-probe", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tt-retry-")})
ship_package(spark)
SF = "/root/testdata/sf0.01"


def flaky(df):
    if not inject:
        return df

    def run(batches):
        if TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("injected executor loss")
        yield from batches
    return df.mapInArrow(run, df.schema)


docs = flaky(S.table(spark, SF, "documents").select("doc_id", "source").repartition(3))
p = DE.softmax(flaky(S.scores(spark, SF)), "request_id", "score", 0.8)
results = {
    "sample": DE.sample_per_group(p, "request_id", "token", n=2, seed=3).select("request_id", "draw", "token"),
    "shuffle": batching.seeded_shuffle(docs.select("doc_id"), "doc_id", 7),
    "batches": batching.plan_batches(docs.withColumn("phase", S.phase_col()), "doc_id", 13, 4, ["phase"]),
    "cond": MA.conditioning_candidates(docs, "source", "doc_id", 2),
}
for name, df in results.items():
    rows = sorted(map(str, df.collect()))
    print(name, hashlib.sha256("\n".join(rows).encode()).hexdigest(), len(rows))
spark.stop()
