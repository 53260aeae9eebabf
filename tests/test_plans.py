"""Physical-plan properties the scale design relies on."""

import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from tunetable import standins as S
from tunetable.operators import decoding as DE
from tunetable.operators import metrics as ME
from tunetable.operators import tensors as TE
from tunetable.plans.prefix import int_bucket, row_index
from tunetable.sources.tensors import read_tensors, write_tensors

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    """Physical plan text with attribute ids removed."""
    import re
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def test_top_k_and_warmup_limit_map_side(spark):
    ev = S.table(spark, SF, "events")
    p = plan(DE.top_k(ev, "user_id", "value", "event_id", k=2))
    assert "WindowGroupLimit" in p and "Partial" in p
    p = plan(ME.latency_summary(ev.withColumn("seconds", F.col("value")), "user_id", ["ts", "event_id"]))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_tensor_filters_reach_the_scan(spark):
    d = tempfile.mkdtemp(prefix="tt-plan-")
    cols = ["tensor", "kind", "row", "ndim", "shape", "dtype", "values"]
    write_tensors(S.base_tensors(spark, SF).select(*cols), d, 1, 1)
    t = read_tensors(spark, d, run_id=1, step=1, tensor_prefix="gpt.h.3.")
    p = plan(TE.target_modules(t, ["c_fc"]).select("tensor", "row"))
    assert "StringStartsWith(tensor,gpt.h.3.)" in p
    assert "Or(EqualTo(tensor,c_fc),StringEndsWith(ten" in p
    assert "PartitionFilters: [isnotnull(run_id), isnotnull(step), (run_id = 1), (step = 1)]" in p
    assert "ReadSchema: struct<tensor:string,row:int>" in p


def test_scans_read_only_needed_columns(spark):
    p = plan(E.queries()["plan_batches"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint>" in p


def test_flagship_runs_the_tokenizer_once(spark):
    p = plan(E.queries()["phase_report"](spark, SF))
    assert "ArrowEvalPython" not in p  # tokenised and checkpointed before the rest of the plan
    assert "Scan ExistingRDD" in p


def test_two_level_index_shuffles_cells_explicitly(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k")).repartition("k")
    p = plan(row_index(df, ["id"], int_bucket("id", 64), ["k"], out="i"))
    assert "hashpartitioning(__tt_p0, __tt_n0, __tt_bucket" in p


def test_bucketed_checkpoints_join_without_shuffle(spark):
    from tunetable.sources.tensors import open_tensor_table, write_tensor_table
    d = tempfile.mkdtemp(prefix="tt-bucket-")
    cols = ["tensor", "kind", "row", "ndim", "shape", "dtype", "values"]
    write_tensor_table(S.base_tensors(spark, SF).select(*cols), d + "/b", buckets=8)
    write_tensor_table(S.tuned_tensors(spark, SF).select(*cols), d + "/t", buckets=8)
    b, t = open_tensor_table(spark, d + "/b", buckets=8), open_tensor_table(spark, d + "/t", buckets=8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(b.join(t, ["tensor", "row"]).select("tensor", "row"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in p and "Exchange" not in p
    assert b.join(t, ["tensor", "row"]).count() == t.count()


def test_reconcile_over_bucketed_checkpoints_has_no_exchange(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(E.queries()["reconcile_state_stored"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in p and "FullOuter" in p and "Exchange" not in p


def test_bucketed_run_step_checkpoints(spark):
    d = tempfile.mkdtemp(prefix="tt-ckpt-") + "/ckpt"
    cols = ["tensor", "kind", "row", "ndim", "shape", "dtype", "values"]
    write_tensors(S.base_tensors(spark, SF).select(*cols), d, 1, 10, buckets=8)
    write_tensors(S.tuned_tensors(spark, SF).select(*cols), d, 1, 20, buckets=8)
    write_tensors(S.tuned_tensors(spark, SF).select(*cols), d, 1, 20, buckets=8)  # rewrite replaces the partition
    a = read_tensors(spark, d, 1, 10, buckets=8)
    b = read_tensors(spark, d, 1, 20, buckets=8)
    assert a.count() == S.base_tensors(spark, SF).count() and b.count() == S.tuned_tensors(spark, SF).count()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(a.join(b, ["tensor", "row"]).select("tensor"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in p and "Exchange" not in p
    got = {r["tensor"]: r["n_changed"] for r in TE.changed_tensors(a, b).collect()}
    exp = {r["tensor"]: r["n_changed"] for r in E.queries()["changed_tensors"](spark, SF).collect()}
    assert got == exp
