"""Executors need no copy of the package."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver alone
from judgelake.llm.queries import QUERIES
from judgelake.session import get_session
spark = get_session(master="local[2]", shuffle_partitions=2)
try:
    spark.sparkContext.range(1).map(lambda _: __import__("judgelake").__name__).collect()
    raise SystemExit("the workers have the package: nothing is shown")
except Exception as e:
    assert "ModuleNotFoundError" in str(e), e
for name in ("op3_secrets", "op4_packing", "op11_whitening", "op12_periodic_runs", "op13_piece_bpe"):
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_without_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    got = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert got["op3_secrets"] == got["op12_periodic_runs"] == got["op13_piece_bpe"] == "200" and got["op11_whitening"] == "4000"
