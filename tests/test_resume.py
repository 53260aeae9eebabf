"""A fit that dies and goes on (X3), checkpoints by step (S5), metrics done twice."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunetable.operators import adapters
from tunetable.operators.adapters import fit_adapter, fit_state, saved_steps
from tunetable.sources import tensors as TS
from tunetable.sources.corpus import read_metrics, read_requests, whole_attempts, write_metrics

rng = np.random.default_rng(1)


def _task(spark):
    X, y = rng.normal(size=(80, 4)), rng.integers(0, 3, size=80)
    data = spark.createDataFrame([(X[i].tolist(), int(y[i])) for i in range(80)], "embedding array<double>, label int").repartition(3)
    base = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(rng.normal(size=(3, 4)))], "row int, values array<double>")
    return data, base


@pytest.mark.parametrize("batch", [None, 30])
def test_a_killed_fit_resumes_to_the_same_result(spark, tmp_path, monkeypatch, batch):
    data, base = _task(spark)
    opts = dict(r=2, alpha=4.0, lr=0.3, seed=2, batch=batch)
    whole_a, whole_l = fit_adapter(spark, data, base, steps=7, **opts)
    path = str(tmp_path / "fit")
    save = adapters._save_state

    def dies(spark_, path_, step, *rest):
        if step == 4:  # the step was computed, its state is lost
            raise KeyboardInterrupt
        save(spark_, path_, step, *rest)

    monkeypatch.setattr(adapters, "_save_state", dies)
    with pytest.raises(KeyboardInterrupt):
        fit_adapter(spark, data, base, steps=7, path=path, **opts)
    monkeypatch.setattr(adapters, "_save_state", save)
    assert saved_steps(spark, path) == [2, 3]
    # a state that was not written to its end doesn't count
    spark.range(1).write.parquet(f"{path}/state/step-4")
    os.remove(f"{path}/state/step-4/_SUCCESS")
    assert fit_state(spark, path)["step"] == 3 and fit_state(spark, path, 2)["step"] == 2 and fit_state(spark, path, 0) is None
    got_a, got_l = fit_adapter(spark, data, base, steps=7, path=path, **opts)
    assert np.allclose([tuple(r) for r in got_l.orderBy("step").collect()], [tuple(r) for r in whole_l.orderBy("step").collect()], rtol=1e-12)
    pick = lambda df: np.concatenate([r["values"] for r in df.orderBy("matrix", "row").collect()])
    assert np.allclose(pick(got_a), pick(whole_a), rtol=1e-12)
    with pytest.raises(ValueError):  # another fit must not go on from here
        fit_adapter(spark, data, base, steps=9, path=path, **(opts | {"lr": 0.1}))


def test_a_step_reads_its_shard_only(spark, tmp_path):
    data, base = _task(spark)
    path = str(tmp_path / "fit")
    _a, losses = fit_adapter(spark, data, base, r=2, steps=4, batch=20, path=path)
    assert sorted(n for n in os.listdir(path) if n.startswith("epoch")) == ["epoch-0"]
    shard = adapters._shard(spark.read.parquet(f"{path}/examples"), path, 0, 0, 2, 4, 80)
    assert "/epoch-0/folder=2" in shard.inputFiles()[0] and shard.count() == losses.filter("step = 2").first()["n_rows"]
    fit_adapter(spark, data, base, r=2, steps=6, batch=20, path=path)
    assert sorted(n for n in os.listdir(path) if n.startswith("epoch")) == ["epoch-1"]  # the epoch before is gone


def test_bucketed_steps_have_a_file_a_bucket_and_expire(spark, tmp_path):
    path = str(tmp_path / "ckpt")
    t = spark.range(500).repartition(7).select(F.concat(F.lit("t"), F.col("id") % 5).alias("tensor"), F.lit("k").alias("kind"), F.col("id").cast("int").alias("row"),
                                               F.lit(1).alias("ndim"), F.array(F.lit(1)).alias("shape"), F.lit("f").alias("dtype"), F.array(F.lit(1.0).cast("float")).alias("values"))
    for step in (1, 2, 3):
        TS.write_tensors(t, path, 7, step, buckets=4)
    files = [f for f in os.listdir(f"{path}/run_id=7/step=2") if f.endswith(".parquet")]
    assert len(files) == 4
    a, b = (TS.read_tensors(spark, path, 7, s, buckets=4).select("tensor", "row", F.col("values").alias(f"v{s}")) for s in (1, 2))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b, ["tensor", "row"])
        assert joined.count() == 500
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert TS.expire_steps(spark, path, 7, keep=1) == [1, 2] and TS.saved_steps(spark, path, 7) == [3]
    assert TS.read_tensors(spark, path, 7).count() == 500


def test_metrics_of_a_doubled_and_a_broken_run(spark, tmp_path):
    path = str(tmp_path / "metrics")
    m = lambda k, n: spark.range(n).select(F.lit(k).cast("long").alias("run_id"), F.col("id").alias("step"))
    write_metrics(m(1, 5), path, job="a")
    write_metrics(m(2, 3), path, job="b")
    write_metrics(m(1, 6), path, job="a")
    write_metrics(m(2, 4), path, job="b")
    last = sorted(os.listdir(f"{path}/job-b"))[-1]
    os.remove(f"{path}/job-b/{last}/_SUCCESS")  # this attempt died
    assert {r.run_id: r.n for r in read_metrics(spark, path).groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {1: 6, 2: 3}
    assert read_metrics(spark, path, run=2).count() == 3 and len(whole_attempts(spark, path)) == 2


def test_request_ids_follow_files_and_lines(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.txt").write_text("one\n\n  two  \n")
    (tmp_path / "r" / "b.txt").write_text("three\nfour")
    got = [(r.request_id, r.text, r.preset) for r in read_requests(spark, str(tmp_path / "r"), "fast").orderBy("request_id").collect()]
    assert got == [(0, "one", "fast"), (1, "two", "fast"), (2, "three", "fast"), (3, "four", "fast")]
