"""Tasks must not depend on the package being importable where they run."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from engram.operators import knn, ranking
from engram.session import local_session
spark = local_session(cpus=1, shuffle_partitions=1)
rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
queries = rows.withColumnRenamed("id", "query_id")
assert ranking.most_similar(rows, [1.0, 0.0]).count() == 1
assert knn.nearest(rows, queries, 2).count() == 2
assert knn.nearest(rows, queries, 2, max_broadcast_bytes=0).count() == 2
"""


def test_tasks_carry_their_code(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False,
    )
    assert done.returncode == 0, done.stderr[-2000:]
