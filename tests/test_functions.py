"""Hand-worked cases (FIXTURES.md §3) for the column functions."""

import pytest
from pyspark.sql import functions as F

from tunetable.functions import arrays as A
from tunetable.functions import lengths as LN
from tunetable.functions import text as TX


def one(spark, col, data, schema):
    return spark.createDataFrame(data, schema).select(col.alias("r")).collect()


def arr(spark, values, col, typ="array<int>"):
    df = spark.createDataFrame([(v,) for v in values], f"a {typ}")
    return [r[0] for r in df.select(col).collect()]


def test_pad_or_truncate(spark):
    assert arr(spark, [[1, 2, 3]] * 1, A.pad_or_truncate("a", 5)) == [[1, 2, 3, 0, 0]]
    assert arr(spark, [[1, 2, 3]], A.pad_or_truncate("a", 2)) == [[1, 2]]
    assert arr(spark, [[1, 2, 3]], A.pad_or_truncate("a", 3)) == [[1, 2, 3]]
    assert arr(spark, [[]], A.pad_or_truncate("a", 2)) == [[0, 0]]
    assert arr(spark, [[1, 2]], A.pad_or_truncate("a", 0)) == [[]]


def test_pad_or_truncate_always_has_size_n(spark):
    df = spark.range(0, 50).select(F.sequence(F.lit(0), F.col("id")).alias("a"), (F.col("id") * 7 % 23).alias("n"))
    sizes = df.select(F.size(A.pad_or_truncate("a", F.col("n").cast("int"))).alias("s"), "n").collect()
    assert all(r["s"] == r["n"] for r in sizes)


def test_pad_right(spark):
    assert arr(spark, [[1, 2, 3]], A.pad_right("a", -1, 9)) == [[1, 2]]
    assert arr(spark, [[1, 2, 3]], A.pad_right("a", 0, 9)) == [[1, 2, 3]]
    assert arr(spark, [[1, 2, 3]], A.pad_right("a", 2, 9)) == [[1, 2, 3, 9, 9]]
    assert arr(spark, [[1, 2, 3]], A.pad_right("a", -5, 9)) == [[]]


def test_align_inputs_targets(spark):
    i, t = A.align_inputs_targets(A.append_stop("a", 0), 255, 0)
    df = spark.createDataFrame([([5, 6],)], "a array<int>").select(i.alias("i"), t.alias("t")).collect()[0]
    assert df["i"] == [255, 5, 6, 0] and df["t"] == [5, 6, 0, 0]


def test_mask_past_end(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], 2048), ([1, 2, 3], 2047)], "a array<int>, w long")
    out = [r[0] for r in df.select(A.mask_past_end("a", "w")).collect()]
    assert out == [[1, 2, 3, 8193, 8193], [1, 2, 8193]]


def test_first_stop_and_fix_codes(spark):
    rows = [[1, 2, 3], [1, 2, 8193, 7, 7, 7, 7], [1, 2, 3, 4, 8193], [8193, 1], []]
    assert arr(spark, rows, A.first_stop("a")) == [None, 2, 4, 0, None]
    assert arr(spark, rows, A.fix_codes("a")) == [[1, 2, 3], [1, 2, 83, 83, 45, 45, 248], [1, 2, 45, 45, 248],
                                                  None, []]


def test_trim_calm_run(spark):
    rows = [[1] + [83] * 8, [1] + [83] * 9, [83] * 5 + [7] + [83] * 9, [83] * 30, []]
    out = arr(spark, rows, A.trim_calm_run("a"))
    assert out[0] == [1] + [83] * 8
    assert out[1] == [1] + [83] * 8
    assert out[2] == ([83] * 5 + [7] + [83] * 9)[:14]
    assert out[3] == [83] * 8
    assert out[4] == []
    assert arr(spark, [[1, 83, 83, 83, 5] + [83] * 10], A.calm_cut("a")) == [13]


def test_position_ids(spark):
    out = arr(spark, [[0, 0, 1, 1, 1], [1, 1, 0, 1], [], None], A.position_ids("a"))
    assert out == [[1, 1, 0, 1, 2], [0, 1, 1, 2], [], None]


def test_crop_or_pad_and_for_each(spark):
    assert arr(spark, [[1, 2], [1, 2, 3, 4, 5]], A.crop_or_pad("a", 3)) == [[1, 2, 0], [1, 2, 3]]
    assert arr(spark, [[1, 2, 3, 4, 5]], A.crop_or_pad("a", 3, 2)) == [[3, 4, 5]]
    assert arr(spark, [[1, 2]], A.for_each("a", lambda x: x * 10)) == [[10, 20]]


def test_seeded_crop_start_is_deterministic_and_in_range(spark):
    df = spark.range(0, 200).select("id", F.sequence(F.lit(0), F.col("id") % 37 + 5).alias("a"))
    s1 = df.select("id", A.seeded_crop_start("a", 5, "id", 11).alias("s"), F.size("a").alias("n")).collect()
    s2 = df.repartition(7).select("id", A.seeded_crop_start("a", 5, "id", 11).alias("s")).collect()
    assert sorted((r["id"], r["s"]) for r in s1) == sorted((r["id"], r["s"]) for r in s2)
    assert all(0 <= r["s"] <= max(r["n"] - 5, 0) for r in s1)


def test_lengths(spark):
    df = spark.createDataFrame([(100,), (1,), (0,), (1023,), (1024,), (551250,)], "n long")
    out = df.select(LN.output_length("n").alias("o"), LN.code_length("n").alias("c")).collect()
    assert [r["o"] for r in out[:3]] == [435, 4, 0]
    assert [r["c"] for r in out[3:]] == [0, 1, 538]


def test_multistep_lr(spark):
    df = spark.createDataFrame([(999,), (1000,), (2000,), (4000,)], "s int")
    lr = [r[0] for r in df.select(LN.multistep_lr("s")).collect()]
    assert lr == [1e-5, 5e-6, 2.5e-6, 1.25e-6]
    w = [r[0] for r in spark.createDataFrame([(0,), (9,), (10,)], "s int").select(LN.multistep_lr("s", warmup=10)).collect()]
    assert w == pytest.approx([1e-6, 1e-5, 1e-5], rel=1e-12)


def test_adapter_arithmetic(spark):
    df = spark.createDataFrame([(1024, 3072), (1024, 1024), (4096, 1024), (1024, 4096)], "i int, o int")
    per_layer = sum(r[0] for r in df.select(LN.adapter_params("i", "o", 16)).collect())
    assert per_layer == 262144 and per_layer * 30 == 7864320
    mlp = sum(r[0] for r in df.filter("i = 4096 or o = 4096").select(LN.adapter_params("i", "o", 8)).collect())
    assert mlp == 81920 and mlp * 7 == 573440
    s = spark.range(1).select(LN.adapter_scale(32, 16).alias("a"), LN.adapter_scale(32, 8).alias("b")).collect()[0]
    assert (s["a"], s["b"]) == (2.0, 4.0)


def test_text_functions(spark):
    df = spark.createDataFrame([("  Hello\t\tWORLD \n x ", "a.wav| hi", "keep [drop me] this [open")],
                               "t string, line string, r string")
    r = df.select(TX.normalise_text("t").alias("n"), TX.normalise_delimiter("line").alias("d"),
                  TX.redact_bracketed("r").alias("x"),
                  TX.rewrite_prefix(F.lit("/old/root/a/old/root/"), "/old/root/", "/new/").alias("p1"),
                  TX.rewrite_prefix(F.lit("/old/root/a/old/root/"), "/old/root/", "/new/", anywhere=True).alias("p2"),
                  TX.rewrite_prefix(F.lit("x/old/root/"), "/old/root/", "/new/").alias("p3")).collect()[0]
    assert r["n"] == "hello world x"
    assert r["d"] == "a.wav\thi"
    assert r["x"] == "keep  this [open"
    assert (r["p1"], r["p2"], r["p3"]) == ("/new/a/old/root/", "/new/a/new/", "x/old/root/")


def test_merge_columns(spark):
    df = spark.createDataFrame([("q", ["a", "b"]), ("q", []), (None, ["a"]), ("q", ["it's"])],
                               "q string, tags array<string>")
    out = [r[0] for r in df.select(TX.merge_columns("q", "tags")).collect()]
    assert out == ["q ->: ['a', 'b']", "q ->: []", None, "q ->: ['it\\'s']"]


def test_arrow_helpers_on_sliced_arrays():
    import numpy as np
    import pyarrow as pa
    from tunetable.functions.arrays import _position_ids_arrow
    full = pa.array([[1, 1], [0, 1, 1], [1, 0], None, [1]], type=pa.list_(pa.int64()))
    got = _position_ids_arrow(full.slice(1, 4)).to_pylist()
    assert got == [[1, 0, 1], [0, 1], None, [0]]
    from tunetable.operators.adapters import _blocks
    off, vals, lengths, *_ = _blocks(pa.array([[1.0], [2.0, 3.0], [4.0]]).slice(1, 2), 16)
    assert off.tolist() == [0, 2, 3] and vals.tolist() == [2.0, 3.0, 4.0] and np.array_equal(lengths, [2, 1])
