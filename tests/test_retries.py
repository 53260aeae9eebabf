"""Results are unchanged when tasks fail and are retried (deterministic operators)."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _digest(mode):
    out = subprocess.run([sys.executable, os.path.join(REPO, "tests", "retry_probe.py"), REPO, mode],
                         capture_output=True, text=True, timeout=600, env={**os.environ, "PYTHONPATH": REPO})
    assert out.returncode == 0, out.stderr[-2000:]
    return [ln for ln in out.stdout.splitlines() if ln and ln.split()[0] in ("sample", "shuffle", "batches", "cond")]


def test_results_survive_task_retries():
    clean = _digest("clean")
    failed = _digest("fail")
    assert len(clean) == 4
    assert clean == failed
