"""Queries from a driver that was started in another folder: workers get the package sent."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

FOLDER = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[2]
NAMES = ["op1_language", "op3_pii", "op4_token_files", "op6_unit_dedup", "op8_simhash", "op9_warc", "op10_packing", "pipeline"]


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the driver's tables")
def test_queries_from_an_empty_folder(tmp_path):
    script = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from sievework.session import local_session
spark = local_session(4, **{{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": {str(tmp_path / "shared")!r}}})
for name in {NAMES!r}:
    assert entry.queries()[name](spark, {str(FOLDER)!r}).count() > 0, name
spark.stop()
"""
    empty = tmp_path / "empty"
    empty.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=empty, env=env, timeout=900, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
