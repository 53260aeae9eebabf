"""Property tests: random arrays through the Spark column functions against
plain-Python statements of the same rules (one Spark job per example batch)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tunetable.functions import arrays as A

CODE = st.one_of(st.just(83), st.just(8193), st.integers(0, 8191))
ARRAYS = st.lists(st.lists(CODE, max_size=40), min_size=1, max_size=25)
SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def py_trim(a, calm=83, run=8):
    r = 0
    for i, x in enumerate(a):
        r = r + 1 if x == calm else 0
        if r > run:
            return a[:i]
    return a


def py_fix(a, stop=8193, calm=83, tail=(45, 45, 248)):
    if stop not in a:
        return a
    if len(a) < len(tail):
        return None
    s = a.index(stop)
    out = [calm if i >= s else x for i, x in enumerate(a)]
    out[-len(tail):] = list(tail)
    return out


def py_position_ids(mask):
    out, c = [], 0
    for m in mask:
        c += m
        out.append(1 if m == 0 else c - 1)
    return out


def run(spark, arrays, *cols):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    return {r["i"]: r for r in df.select("i", *cols).collect()}


@SETTINGS
@given(arrays=ARRAYS, n=st.integers(0, 45), k=st.integers(-50, 10))
def test_padding_rules(spark, arrays, n, k):
    out = run(spark, arrays, A.pad_or_truncate("a", n, 7).alias("p"), A.pad_right("a", k, 9).alias("r"),
              A.crop_or_pad("a", n).alias("c"))
    for i, a in enumerate(arrays):
        assert out[i]["p"] == (a + [7] * n)[:n]
        assert out[i]["r"] == (a + [9] * k if k >= 0 else a[:max(len(a) + k, 0)])
        assert out[i]["c"] == ((a + [0] * n)[:n] if len(a) <= n else a[:n])


@SETTINGS
@given(arrays=ARRAYS)
def test_code_repairs(spark, arrays):
    out = run(spark, arrays, A.trim_calm_run("a").alias("t"), A.fix_codes("a").alias("f"),
              A.first_stop("a").alias("s"))
    for i, a in enumerate(arrays):
        assert out[i]["t"] == py_trim(a)
        assert out[i]["f"] == py_fix(a)
        assert out[i]["s"] == (a.index(8193) if 8193 in a else None)


@SETTINGS
@given(arrays=ARRAYS, wav=st.integers(0, 50_000))
def test_mask_and_positions(spark, arrays, wav):
    out = run(spark, arrays, A.mask_past_end("a", F.lit(wav)).alias("m"),
              A.position_ids(F.transform("a", lambda x: F.when(x == 83, 0).otherwise(1))).alias("p"))
    end = wav // 1024 + 1
    for i, a in enumerate(arrays):
        assert out[i]["m"] == [8193 if j >= end else x for j, x in enumerate(a)]
        assert out[i]["p"] == py_position_ids([0 if x == 83 else 1 for x in a])
