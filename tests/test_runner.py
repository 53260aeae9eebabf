"""The spark-submit runner writes one Parquet result per query."""

import os
import subprocess
import sys
import tempfile

import pandas as pd

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_run_query_writes_results():
    out = tempfile.mkdtemp(prefix="tt-runner-")
    r = subprocess.run([sys.executable, os.path.join(REPO, "tools", "run_query.py"), "--input", "/root/testdata/sf0.001",
                        "--output", out, "--query", "plan_batches", "--query", "latency_summary"],
                       capture_output=True, text=True, timeout=600, env={**os.environ, "PYTHONPATH": REPO})
    assert r.returncode == 0, r.stderr[-2000:]
    assert sorted(os.listdir(out)) == ["latency_summary", "plan_batches"]
    batches = pd.read_parquet(os.path.join(out, "plan_batches"))
    assert len(batches) == 200 and set(batches.columns) >= {"doc_id", "phase", "batch_id", "position", "micro_id"}
    bad = subprocess.run([sys.executable, os.path.join(REPO, "tools", "run_query.py"), "--input", "/root/testdata/sf0.001",
                          "--output", out, "--query", "nope"], capture_output=True, text=True, timeout=600,
                         env={**os.environ, "PYTHONPATH": REPO})
    assert bad.returncode != 0 and "unknown queries" in (bad.stderr + bad.stdout)


def test_scale_copy_offsets_ids():
    out = tempfile.mkdtemp(prefix="tt-scale-")
    r = subprocess.run([sys.executable, os.path.join(REPO, "tools", "scale_copy.py"), "/root/testdata/sf0.001",
                        os.path.join(out, "x2"), "2"], capture_output=True, text=True, timeout=600,
                       env={**os.environ, "PYTHONPATH": REPO})
    assert r.returncode == 0, r.stderr[-2000:]
    docs = pd.read_parquet(os.path.join(out, "x2", "documents.parquet"))
    base = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    assert len(docs) == 2 * len(base) and docs.doc_id.is_unique
    assert sorted(docs.text) == sorted(list(base.text) * 2)
