"""Nulls, NaN, plain doubles and unknown keys keep their rows and their values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunetable.operators import adapters, batching, codes, decoding, manifest, metrics


def test_null_order_keys_stay(spark):
    df = spark.createDataFrame([(1,), (None,), (3,), (2,), (4097,)], "doc_id long")
    out = batching.plan_batches(df, "doc_id", 2)
    assert out.count() == 5
    assert out.filter("doc_id IS NULL").first()["batch_id"] == 0


def test_null_groups_condition_each_other(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), (None, 5)], "g string, id long")
    out = manifest.conditioning_candidates(df, "g", "id", 2)
    assert sorted((r.id, r.cond_id) for r in out.collect()) == [(1, 2), (2, 1), (3, 4), (3, 5), (4, 3), (4, 5), (5, 3), (5, 4)]


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_one_bad_score_does_not_empty_a_group(spark, bad):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, bad), (1, 2, 3.0)], "g int, t int, s double")
    for out in (decoding.nucleus_filter(df, "g", "s", "t"), decoding.typical_filter(df, "g", "s", "t")):
        kept = {r.t for r in out.collect()}
        assert kept and 1 not in kept


def test_latency_of_large_warm_up_and_null_groups(spark):
    rows = [("a", 1, math.inf), ("a", 2, 1e17), ("a", 3, 5.0), ("a", 4, 7.0), (None, 1, 1.0), (None, 2, 2.0), (None, 3, 3.0), ("b", 1, 1.0), ("c", 1, 2.0), ("c", 1, 2.0), ("c", 1, 2.0), ("c", 1, 9.0)]
    out = {r.g: (r.n_requests, r.total_seconds, r.mean_seconds) for r in metrics.latency_summary(spark.createDataFrame(rows, "g string, o int, seconds double"), "g", "o").collect()}
    assert out == {"a": (2, 12.0, 6.0), None: (1, 3.0, 3.0), "b": (0, None, None), "c": (2, 11.0, 5.5)}


def test_rolling_mean_of_doubles_and_nulls(spark):
    rows = [(1, i, v) for i, v in enumerate([1e17, 1.0, 1.0, 1.0, None, None, None, 4.0])]
    out = metrics.rolling_mean(spark.createDataFrame(rows, "g int, o long, v double"), "g", "o", "v", n=2)
    assert [r.rolling_mean for r in out.orderBy("o").collect()] == [1e17, (1e17 + 1) / 2, 1.0, 1.0, 1.0, None, None, 4.0]


def test_adapters_by_string_null_and_unknown_id(spark):
    base = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "row int, values array<double>")
    ad = spark.createDataFrame([("a1", [[1.0, 1.0]], [[1.0], [2.0]])], "adapter_id string, lora_A array<array<double>>, lora_B array<array<double>>")
    vec = spark.createDataFrame([(1, [1.0, 2.0], "a1"), (2, [1.0, 2.0], "zz"), (3, [1.0, 2.0], None)], "vec_id int, embedding array<double>, adapter_id string")
    out = {r.vec_id: r.output for r in adapters.apply_adapter(vec, base, ad, alpha=1.0, r=1).collect()}
    assert out == {1: [4.0, 8.0], 2: None, 3: None}


def test_fit_uses_labels_by_row_number(spark):
    base = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.0, 1.0])], "row int, values array<double>")
    data = spark.createDataFrame([([1.0, 0.0], 0), ([0.0, 1.0], 5), ([0.0, 1.0], 5), ([1.0, 1.0], 1)], "embedding array<double>, label int")
    _, loss = adapters.fit_adapter(spark, data, base, r=1, steps=1)
    p = math.e / (math.e + 1)
    assert loss.first()["loss"] == pytest.approx(-math.log(p))


def test_quantised_null_array_stays_null(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0]), (2, None), (3, [])], "id int, v array<float>")
    q = df.select("id", adapters.quantise_blocks("v").alias("q"))
    out = {r.id: r.d for r in q.select("id", adapters.dequantise_blocks("q").alias("d")).collect()}
    assert out[2] is None and out[3] == [] and len(out[1]) == 2


def test_nearest_code_far_from_the_origin(spark):
    rng = np.random.default_rng(3)
    book, x = rng.normal(size=(40, 8)) + 1e7, rng.normal(size=(200, 8)) + 1e7
    want = ((x[:, None] - book[None]) ** 2).sum(-1).argmin(1)
    to_df = lambda m, name: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], f"{name} long, embedding array<double>")
    got = {r.vec_id: r.code for r in codes.assign_codes(to_df(x, "vec_id"), to_df(book, "code")).collect()}
    assert [got[i] for i in range(200)] == want.tolist()


def test_stream_without_a_file_limit(spark):
    from tunetable.streaming import rowlocal

    df = rowlocal.stream_parquet(spark, "/root/testdata/sf0.001/events.parquet")
    assert df.isStreaming and df.select(F.col("ts")).columns == ["ts"]
