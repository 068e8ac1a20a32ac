import os
import subprocess
import sys

from conftest import ROOT, TINY

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from tidemark.session import local_session
spark = local_session("4", shuffle_partitions=4)
for name in ("stateful_score_batch", "stateful_score_stream", "train_avg_recurrent", "train_avg_softmax"):
    assert entry.queries()[name](spark, {TINY!r}).count() > 0, name
print("all ran")
"""


def test_workers_need_no_installed_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-3000:]
