"""Two-level prefix scheme, batching and packing: equality with plain windows,
partition independence (1, 4, 17 partitions) and the stated properties."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tunetable import standins as S
from tunetable.functions.arrays import char_codes
from tunetable.operators import batching, metrics
from tunetable.plans import prefix
from tunetable.plans.prefix import int_bucket, ranged_index, ranged_sum, row_index, running_sum, time_bucket

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_running_sum_equals_window(spark, parts):
    d = S.table(spark, SF, "documents").select("doc_id", "n_chars", "source").repartition(parts)
    got = running_sum(d, "n_chars", ["doc_id"], int_bucket("doc_id", 64), ["source"], out="cs").select("doc_id", "cs")
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    exp = d.select("doc_id", F.sum("n_chars").over(w).alias("cs"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_row_index_time_bucket_matches_row_number(spark):
    ev = S.table(spark, SF, "events").select("user_id", "ts", "event_id")
    got = row_index(ev, ["ts", "event_id"], time_bucket("ts", 600), ["user_id"], out="i").select("event_id", "i")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    exp = ev.select("event_id", (F.row_number().over(w) - 1).alias("i"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_plan_batches_every_row_once(spark):
    d = S.table(spark, SF, "documents").select("doc_id", S.phase_col().alias("phase"))
    b = batching.plan_batches(d, "doc_id", 13, micro=4, partition=["phase"])
    rows = b.collect()
    assert len(rows) == d.count() == len({r["doc_id"] for r in rows})
    for ph in ("train", "val"):
        ids = sorted(r["doc_id"] for r in rows if r["phase"] == ph)
        pos = {r["doc_id"]: (r["batch_id"], r["position"], r["micro_id"]) for r in rows if r["phase"] == ph}
        for i, doc in enumerate(ids):
            assert pos[doc] == (i // 13, i % 13, (i % 13) // 4)


def test_pack_blocks_properties(spark):
    d = S.table(spark, SF, "documents").select("doc_id", char_codes(F.col("text")).alias("tokens"))
    blocks = batching.pack_blocks(d, "tokens", "doc_id", block=1024).orderBy("block_id").collect()
    total = d.select(F.sum(F.size("tokens"))).collect()[0][0]
    assert sum(b["n_tokens"] for b in blocks) == total
    assert all(b["n_tokens"] == 1024 for b in blocks[:-1]) and 0 < blocks[-1]["n_tokens"] <= 1024
    assert [b["block_id"] for b in blocks] == list(range(len(blocks)))
    stream = [t for r in d.orderBy("doc_id").collect() for t in r["tokens"]]
    assert [t for b in blocks for t in b["tokens"]] == stream


def test_corpus_budget_and_step_plan(spark):
    df = spark.createDataFrame([(2391884,)], "n long")
    assert batching.corpus_budget(df, "n", 1024, 8).collect()[0]["n_blocks"] == 2336
    from tunetable.operators.manifest import phase_limits
    ex = spark.range(1000).select(F.lit("p").alias("phase"))
    lim = spark.createDataFrame([("p", 0, 0, 2, 0)], "phase string, max_text int, max_wav long, batch int, n_cond int")
    r = batching.step_plan(ex, lim, accumulate=4, max_steps=500).collect()[0]
    assert (r["effective_batch"], r["steps_per_epoch"]) == (8, 125)
    assert phase_limits(spark).count() == 2


def test_collate_causal(spark):
    df = spark.createDataFrame([(0, [5, 6, 7]), (0, [8]), (1, [1, 2])], "b int, t array<int>")
    out = sorted(batching.collate_causal(df, "b", "t", pad=0).collect(), key=lambda r: (r["b"], -len(r["t"])))
    assert out[0]["input_ids"] == [5, 6, 7] and out[0]["labels"] == [5, 6, 7]
    assert out[1]["input_ids"] == [8, 0, 0] and out[1]["labels"] == [8, -100, -100]
    assert out[1]["attention_mask"] == [1, 0, 0]
    assert out[2]["padded_len"] == 2


def test_seeded_shuffle_is_a_permutation_and_reproducible(spark):
    d = S.table(spark, SF, "documents").select("doc_id")
    a = {r["doc_id"]: r["shuffle_pos"] for r in batching.seeded_shuffle(d, "doc_id", 42).collect()}
    b = {r["doc_id"]: r["shuffle_pos"] for r in batching.seeded_shuffle(d.repartition(5), "doc_id", 42).collect()}
    assert a == b and sorted(a.values()) == list(range(len(a)))
    assert a != {r["doc_id"]: r["shuffle_pos"] for r in batching.seeded_shuffle(d, "doc_id", 43).collect()}


@pytest.mark.parametrize("n", [1, 3, 16])
def test_rolling_mean_halo_equals_window(spark, n):
    s = S.step_losses(spark, SF).withColumn("v", F.col("loss_text_ce").cast("decimal(18,2)"))
    got = metrics.rolling_mean(s, "run_id", "step", "v", n=n, width=16).select("run_id", "step", "rolling_mean_sum",
                                                                                "rolling_mean_count")
    w = Window.partitionBy("run_id").orderBy("step").rowsBetween(-(n - 1), 0)
    exp = s.select("run_id", "step", F.sum("v").over(w).alias("a"), F.count("v").over(w).alias("b"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


@pytest.mark.parametrize("fan", [2, 1024])
@pytest.mark.parametrize("parts", [1, 5])
def test_ranged_sums_equal_windows(spark, monkeypatch, fan, parts):
    monkeypatch.setattr(prefix, "FAN", fan)  # with 2, eight ranges need all three levels
    d = S.table(spark, SF, "documents").select(
        F.xxhash64("doc_id").alias("h"), F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 11 > 0, F.col("n_chars")).alias("n"), (F.col("doc_id") * 10**12).alias("far"), "doc_id").repartition(parts)
    w = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    exp = d.select("doc_id", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("s"), (F.row_number().over(w) - 1).alias("i"))
    sums = ranged_sum(d, "n", ["h"], ["source"], out="s")
    assert set(sums.columns) == {*d.columns, "s"}
    got = sums.select("doc_id", "s").join(ranged_index(d, ["h"], ["source"], out="i").select("doc_id", "i"), "doc_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))
    far = ranged_sum(d, "n", ["far"], out="s", inclusive=False).orderBy("far").collect()
    assert [r.s for r in far] == [sum(x.n or 0 for x in far[:i]) for i in range(len(far))]
    assert ranged_index(d.limit(0), ["far"]).count() == 0


def test_ranges_are_as_many_as_partitions_whatever_the_keys(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows would fit into one partition
    for key in (F.col("id") * 10**13, F.xxhash64("id"), F.col("id").cast("string")):
        cells = prefix._dealt(spark.range(8000).select(key.alias("k")), ["k"], []).groupBy("__cell").count().collect()
        assert len(cells) >= 4 and max(r["count"] for r in cells) < 4000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_null_keys_and_equal_keys_have_places(spark):
    df = spark.createDataFrame([(None,), (None,), (3,), (3,), (1,)], "k int")
    assert sorted((r.idx, r.k or 0) for r in ranged_index(df, ["k"]).collect()) == [(0, 0), (1, 0), (2, 1), (3, 3), (4, 3)]
    b = batching.plan_batches(df, "k", 2).collect()
    assert sorted((r.batch_id, r.position) for r in b) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
