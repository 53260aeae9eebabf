"""Registered queries against their SQL, and the pipeline against plain Python."""

import re

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tunetable.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


def _plain(v):
    """Text of a value; whole numbers alike whether a null beside them made them floats or not."""
    return "null" if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [sorted(tuple(_plain(v) for v in r) for r in x[columns].values.tolist()) for x in (got, want)]
    assert rows[0] == rows[1]


def test_all_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        out[name] = now.toPandas()
        now = spark.createDataFrame(out[name]) if name != "BPE" else now
    rows = docs.toPandas()
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    tools = model.compressors()
    stay = [i for i, t in zip(rows.doc_id, rows.text) if model.score(model.evidence(t, tools)) < corpus_pipeline.TOXIC]
    assert sorted(out["toxicity"].doc_id) == stay
    left = rows[rows.doc_id.isin(stay)]
    first = left.groupby(left.text.map(lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t))).doc_id.min()
    assert sorted(out["exact dedup"].doc_id) == sorted(first)
    assert set(out["near dedup"].doc_id) <= set(first) and len(out["near dedup"]) < len(first)
    assert set(out["source mixing"].doc_id) <= set(out["near dedup"].doc_id)
    assert all(list(out[n].columns) == docs.columns for n in list(out)[:-1])
    assert sorted(out["BPE"].doc_id) == sorted(out["source mixing"].doc_id)
    assert corpus_pipeline.run(spark, SF).count() == len(out["BPE"])
