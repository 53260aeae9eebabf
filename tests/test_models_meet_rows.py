"""Rows that meet their model (J8, X2), codebooks in blocks (J7) and vector sums (A5), against NumPy."""

import numpy as np
import pyarrow as pa
import pytest

from tunetable.operators import codes as CO
from tunetable.operators.adapters import apply_adapter
from tunetable.operators.codes import assign_codes, pool_mean, vector_sums
from tunetable.plans.meeting import heavy_keys, per_model
from tunetable.plans.scoring import Conditioning, score_conditioned

rng = np.random.default_rng(4)


def test_only_heavy_keys_get_salts(spark):
    rows = spark.createDataFrame([("hot",)] * 95 + [("warm",)] * 21 + [("cold",)] * 20 + [(None,)] * 50, "k string")
    assert {(r["k"], r["__salts"]) for r in heavy_keys(rows, "k", 20, 4).collect()} == {("hot", 4), ("warm", 2)}


def test_models_are_loaded_once_for_each_salt(spark):
    loads = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 9}" if i % 2 else None) for i in range(300)], "id long, key string").repartition(4)
    models = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("unused", 4)], "key string, v int")

    def load(_shared, m):
        loads.add(1)
        return m["v"].as_py()

    def fn(_shared, model, part):
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array([model] * part.num_rows, pa.int32()), pa.array([part.num_rows] * part.num_rows)], names=["id", "v", "n"])

    out = per_model(models, rows, "key", load, fn, "id long, v int, n long", rows_per_task=40).collect()
    want = {"hot": 1, "k0": 2, "k3": 3}
    assert {(r.id, r.v) for r in out} == {(i, want.get("hot" if i % 3 else f"k{i % 9}" if i % 2 else None)) for i in range(300)}
    assert len(out) == 300 and max(r.n for r in out if r.v == 1) < 60  # the hot key's 200 rows came in five parts
    assert loads.value == 5 + 3  # its model five times, the others once
    assert per_model(models, rows.limit(0), "key", load, fn, "id long, v int, n long").collect() == []
    assert {r.v for r in per_model(models.limit(0), rows, "key", load, fn, "id long, v int, n long").collect()} == {None}


def test_a_hot_adapter_is_split_and_gives_the_same(spark):
    W, A, B = rng.normal(size=(3, 4)), rng.normal(size=(2, 4)), rng.normal(size=(3, 2))
    X = rng.normal(size=(120, 4))
    vec = spark.createDataFrame([(i, X[i].tolist(), "a") for i in range(120)], "vec_id long, embedding array<double>, adapter_id string")
    base = spark.createDataFrame([(i, W[i].tolist()) for i in range(3)], "row int, values array<double>")
    ad = spark.createDataFrame([("a", A.tolist(), B.tolist())], "adapter_id string, lora_A array<array<double>>, lora_B array<array<double>>")
    for per_task in (10, 1000):
        out = {r.vec_id: r.output for r in apply_adapter(vec, base, ad, 4.0, 2, rows_per_task=per_task).collect()}
        assert all(np.allclose(out[i], W @ X[i] + 2 * B @ (A @ X[i])) for i in range(120))
    with pytest.raises(ValueError):
        apply_adapter(vec, base, ad, 4.0, 2, max_bytes=50)


def _brute_codes(X, codes, book):
    d = ((X[:, None, :] - book[None]) ** 2).sum(axis=2)
    return [min(zip(row, codes)) for row in d]


@pytest.mark.parametrize("same_norm", [False, True])
@pytest.mark.parametrize("max_bytes", [1 << 20, 3000, 400])
def test_codebook_in_blocks(spark, same_norm, max_bytes):
    book = rng.normal(size=(90, 6))
    if same_norm:  # norms can't rule any block out
        book /= np.sqrt((book * book).sum(axis=1, keepdims=True))
    book[40] = book[7]  # a tie
    codes = rng.permutation(1000)[:90]
    X = np.concatenate([rng.normal(size=(150, 6)), book[[7, 40, 3]], np.zeros((1, 6)), 100 * rng.normal(size=(5, 6))])
    rows = [(i, x.tolist()) for i, x in enumerate(X)] + [(900, None), (901, [1.0]), (None, X[0].tolist()), (0, X[0].tolist())]
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    cb = spark.createDataFrame([(int(c), b.tolist()) for c, b in zip(codes, book)], "code long, embedding array<double>")
    out = assign_codes(vec, cb, max_bytes=max_bytes, rows_per_task=50).collect()
    assert len(out) == len(rows)
    want = _brute_codes(X, codes.tolist(), book)
    for r in out:
        if r.vec_id in (900, 901):
            assert r.code is None and r.dist is None
        else:
            dist, code = want[r.vec_id or 0]
            assert r.code == code and np.isclose(r.dist, dist)


def test_blocks_travel_to_chunks_of_vectors(spark, monkeypatch):
    """Where norms rule no block out, tasks get vectors twice and codes once a chunk, not every vector once a block."""
    book, X = rng.normal(size=(400, 6)), rng.normal(size=(2000, 6))
    book, X = (m / np.sqrt((m * m).sum(axis=1, keepdims=True)) for m in (book, X))
    rows = [(i, x.tolist()) for i, x in enumerate(X)] + [(9000, None), (9001, [0.5]), (9002, [None] * 6)]
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    cb = spark.createDataFrame([(c, b.tolist()) for c, b in enumerate(book)], "code long, embedding array<double>")
    given, plain = [], type(vec).mapInArrow
    monkeypatch.setattr(CO, "CHUNK_BYTES", (500 * 48, 500 * 48), raising=False)
    monkeypatch.setattr(type(vec), "mapInArrow", lambda df, *a, **k: given.append(df) or plain(df, *a, **k))
    got = {r.vec_id: (r.code, r.dist) for r in assign_codes(vec, cb, max_bytes=480).collect()}
    assert sum(df.count() for df in given) < 10 * (len(X) + len(book))
    for i, (dist, code) in enumerate(_brute_codes(X, list(range(400)), book)):
        assert got[i][0] == code and np.isclose(got[i][1], dist)
    assert [got[i] for i in (9000, 9001, 9002)] == [(None, None)] * 3 and len(got) == len(rows)


def test_an_empty_codebook_raises(spark):
    vec = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        assign_codes(vec, spark.createDataFrame([], "code long, embedding array<double>"))


def test_vector_sums(spark, monkeypatch):
    monkeypatch.setattr(CO, "GROUPS", 3)
    rows = [(i % 7 if i % 7 != 5 else None, i % 2, [float(i), None, 2.0 * i] if i % 3 else [float(i)]) for i in range(200)] + [(1, 1, None), (99, 0, None), (98, 0, [])]
    df = spark.createDataFrame(rows, "a int, b int, v array<double>").repartition(4)
    want = {}
    for a, b, v in rows:
        s = want.setdefault((a, b), {})
        for i, x in enumerate(v or ()):
            if x is not None:
                s.setdefault(i, []).append(x)
    got = {(r.a, r.b): r for r in vector_sums(df, ["a", "b"], "v").collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert [(s, n) for s, n in zip(r.sums, r.counts) if n] == [(sum(x), len(x)) for _, x in sorted(want[k].items())]
    mean = {(r.a, r.b): r.pooled for r in pool_mean(df, ["a", "b"], "v").collect()}
    assert mean.keys() == {k for k, v in want.items() if v}
    assert mean[(None, 1)][1] is None and np.isclose(mean[(None, 1)][0], np.mean(want[(None, 1)][0]))
    assert pool_mean(df.limit(0), "a", "v").collect() == []


def test_conditioning_is_computed_once_a_key(spark, tmp_path):
    loader = lambda: 2.0
    embed, finish = (lambda m, x: x[:, :3] * m), (lambda m, keys, x: x)
    refs = spark.createDataFrame([(i % 4, [float(i)] * 5) for i in range(40)] + [(0, None), (0, [1.0])], "voice int, x array<double>").repartition(3)
    asked = lambda ks: spark.createDataFrame([(i, k) for i, k in enumerate(ks)], "id long, voice int")
    path = str(tmp_path / "latents")
    store = Conditioning(spark, embed, finish, loader, dim=5, path=path)
    first = {r.key: r.latent for r in store.latents(asked([0, 0, 1, 9, None]), refs, "voice", "x").collect()}
    assert store.computed.value == 2 and first.keys() == {"0", "1"}  # no reference, no row; unasked voices aren't computed
    assert first["1"] == [2 * np.mean([i for i in range(40) if i % 4 == 1])] * 3
    store.latents(asked([1, 2, 0]), refs, "voice", "x").collect()
    assert store.computed.value == 3  # voice 2 only
    other = Conditioning(spark, embed, finish, loader, dim=5, path=path)  # another program
    assert {r.key for r in other.latents(asked([0, 1, 2]), refs, "voice", "x").collect()} == {"0", "1", "2"} and other.computed.value == 0

    def score(model, latent, part):
        s = [None if latent is None else float(latent[0]) + model] * part.num_rows
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(s, pa.float64())], names=["id", "s"])

    requests = asked([0, 1, 9, None] * 30)
    out = {r.id: r.s for r in score_conditioned(requests, store.stored(), "voice", loader, score, "id long, s double", rows_per_task=10).collect()}
    assert len(out) == 120 and all(out[i] == (first[str(i % 4)][0] + 2 if i % 4 < 2 else None) for i in range(120))


def test_an_unfinished_generation_is_not_read(spark, tmp_path):
    path = tmp_path / "latents"
    (path / "half").mkdir(parents=True)
    spark.createDataFrame([("0", [9.0])], "key string, latent array<double>").write.mode("append").parquet(str(path / "half"))
    (path / "half" / "_SUCCESS").unlink()
    refs = spark.createDataFrame([(0, [1.0])], "voice int, x array<double>")
    store = Conditioning(spark, lambda m, x: x, lambda m, k, x: x, lambda: None, dim=1, path=str(path))
    assert [r.latent for r in store.latents(refs, refs, "voice", "x").collect()] == [[1.0]]


def test_json_keys_tell_null_from_text(spark):
    df = spark.createDataFrame([(None, [1.0]), ("null", [2.0])], "g string, v array<double>")
    assert {(r.g, r.sums[0]) for r in vector_sums(df, "g", "v").collect()} == {(None, 1.0), ("null", 2.0)}
