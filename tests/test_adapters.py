"""Adapters against NumPy twins, and the 4-bit block quantisation bound."""

import numpy as np
import pytest

from tunetable.operators.adapters import (NF4_MAX_GAP, apply_adapter, dequantise_blocks, fit_adapter,
                                          merge_adapter, quantise_blocks)

rng = np.random.default_rng(0)


def _base_df(spark, name, W):
    return spark.createDataFrame([(name, i, W[i].tolist()) for i in range(W.shape[0])],
                                 "tensor string, row int, values array<double>")


@pytest.mark.parametrize("fifo", [False, True])
def test_merge_adapter_matches_numpy(spark, fifo):
    r, alpha = 3, 6.0
    W = rng.normal(size=(5, 4))  # stored rows
    if not fifo:   # W is out x in: A r x in, B out x r
        A, B = rng.normal(size=(r, 4)), rng.normal(size=(5, r))
        expect = W + alpha / r * (B @ A)
    else:          # W stored in x out: delta transposed
        A, B = rng.normal(size=(r, 5)), rng.normal(size=(4, r))
        expect = W + alpha / r * (B @ A).T
    base = _base_df(spark, "t", W).union(_base_df(spark, "other", W[:2]))
    ad = spark.createDataFrame([("t", A.tolist(), B.tolist())],
                               "tensor string, lora_A array<array<double>>, lora_B array<array<double>>")
    out = {(x["tensor"], x["row"]): x["values"] for x in merge_adapter(base, ad, alpha, r, fifo).collect()}
    for i in range(5):
        assert np.allclose(out[("t", i)], expect[i])
    assert np.allclose(out[("other", 1)], W[1])


def test_apply_adapter_matches_numpy(spark):
    d, k, r, alpha = 6, 4, 2, 4.0
    W = rng.normal(size=(k, d))
    ads = {a: (rng.normal(size=(r, d)), rng.normal(size=(k, r))) for a in (0, 1)}
    X = rng.normal(size=(30, d)).astype(np.float32)
    vec = spark.createDataFrame([(i, X[i].tolist(), i % 3) for i in range(30)],
                                "vec_id long, embedding array<float>, adapter_id int")
    base = spark.createDataFrame([(i, W[i].tolist()) for i in range(k)], "row int, values array<double>")
    adf = spark.createDataFrame([(a, A.tolist(), B.tolist()) for a, (A, B) in ads.items()],
                                "adapter_id int, lora_A array<array<double>>, lora_B array<array<double>>")
    out = {x["vec_id"]: x["output"] for x in apply_adapter(vec, base, adf, alpha, r).collect()}
    for i in range(30):
        if i % 3 not in ads:
            assert out[i] is None  # an adapter that isn't there has no output, rather than the base's
            continue
        x = X[i].astype(np.float64)
        A, B = ads[i % 3]
        assert np.allclose(np.array(out[i]), W @ x + alpha / r * (B @ (A @ x)))


def test_fit_adapter_matches_numpy_twin(spark):
    from tunetable.operators.adapters import _softmax_grads
    d, k, r, alpha, lr, steps = 5, 3, 2, 4.0, 0.5, 4
    X = rng.normal(size=(60, d)).astype(np.float32)
    y = rng.integers(0, k, size=60)
    W = rng.normal(size=(k, d))
    data = spark.createDataFrame([(X[i].tolist(), int(y[i])) for i in range(60)], "embedding array<float>, label int").repartition(3)
    base = spark.createDataFrame([(i, W[i].tolist()) for i in range(k)], "row int, values array<double>")
    adapter, losses = fit_adapter(spark, data, base, r=r, alpha=alpha, lr=lr, steps=steps, seed=3)
    # NumPy twin
    A = np.random.default_rng(3).normal(0.0, 0.01, size=(r, d))
    B = np.zeros((k, r))
    Xd = X.astype(np.float64)
    exp_losses = []
    for _ in range(steps):
        loss, gA, gB = _softmax_grads(Xd, y, W, A, B, alpha / r, k)
        exp_losses.append(loss / 60)
        A, B = A - lr * gA / 60, B - lr * gB / 60
    got = [x["loss"] for x in losses.orderBy("step").collect()]
    assert np.allclose(got, exp_losses)
    assert got[-1] < got[0]
    Bgot = np.array([x["values"] for x in adapter.filter("matrix = 'B'").orderBy("row").collect()])
    assert np.allclose(Bgot, B)


def test_quantise_roundtrip_error_bound(spark):
    X = rng.normal(size=(40, 100)) * rng.uniform(0.01, 10, size=(40, 1))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(40)] + [(99, [])], "i int, v array<double>")
    q = df.withColumn("q", quantise_blocks("v", 16)).withColumn("d", dequantise_blocks("q", 16)).collect()
    for r in q:
        v, dq = np.array(r["v"]), np.array(r["d"])
        assert len(dq) == len(v)
        if len(v) == 0:
            continue
        assert len(r["q"]["codes"]) == len(v) and len(r["q"]["scale_codes"]) == -(-len(v) // 16)
        assert np.max(np.abs(v - dq)) <= np.max(np.abs(v)) * (NF4_MAX_GAP / 2 + 1 / 255) + 1e-12


def test_apply_adapter_takes_text_ids_a_hot_adapter_and_nulls(spark):
    d, k, r = 4, 3, 2
    W = rng.normal(size=(k, d))
    ads = {a: (rng.normal(size=(r, d)), rng.normal(size=(k, r))) for a in ("hot", "cold", "unused")}
    names = ["hot" if i % 3 else ("cold" if i % 2 else None) for i in range(200)] + ["unknown"]
    X = rng.normal(size=(201, d)).astype(np.float32)
    vec = spark.createDataFrame([(i, None if i == 5 else X[i].tolist(), names[i]) for i in range(201)],
                                "vec_id long, embedding array<float>, adapter_id string")
    base = spark.createDataFrame([(i, W[i].tolist()) for i in range(k)], "row int, values array<double>")
    adf = spark.createDataFrame([(a, A.tolist(), B.tolist()) for a, (A, B) in ads.items()],
                                "adapter_id string, lora_A array<array<double>>, lora_B array<array<double>>")
    out = {x["vec_id"]: x["output"] for x in apply_adapter(vec, base, adf, 4.0, r, salts=5).collect()}
    assert len(out) == 201
    for i, a in enumerate(names):
        if a not in ads or i == 5:
            assert out[i] is None, i
        else:
            A, B = ads[a]
            x = X[i].astype(np.float64)
            assert np.allclose(out[i], W @ x + 2.0 * (B @ (A @ x)))


def test_fit_adapter_mini_batches_cover_every_row_once_an_epoch(spark):
    X = rng.normal(size=(90, 4)).astype(np.float32)
    y = rng.integers(0, 3, size=90)
    W = rng.normal(size=(3, 4))
    data = spark.createDataFrame([(X[i].tolist(), int(y[i])) for i in range(90)] + [([1.0] * 4, 77), ([1.0], 0), (None, 1)],
                                 "embedding array<float>, label int").repartition(3)
    base = spark.createDataFrame([(i, W[i].tolist()) for i in range(3)], "row int, values array<double>")
    _a, losses = fit_adapter(spark, data, base, r=2, steps=6, batch=30, seed=1)
    n = [x["n_rows"] for x in losses.orderBy("step").collect()]
    assert sum(n[:3]) == sum(n[3:]) == 90 and max(n) < 90  # rows that can't train are in no batch
    again = fit_adapter(spark, data.repartition(5), base, r=2, steps=6, batch=30, seed=1)[1]
    assert np.allclose([x["loss"] for x in again.orderBy("step").collect()], [x["loss"] for x in losses.orderBy("step").collect()])
