"""The shared folder where a local session names none."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

CODE = """
from chorus.workspace import local_session, shared_dir, stage
spark = local_session(1, "bare")
assert spark.conf.get("spark.checkpoint.dir", None) is None
first, second = shared_dir(spark, "a"), shared_dir(spark, "b")
assert first.split("/chorus/")[0] == second.split("/chorus/")[0]
assert stage(spark.range(3), "numbers").count() == 3
"""


def test_a_local_session_without_settings_stages_tables(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path),
           "PYTHONPATH": str(Path(__file__).resolve().parent.parent)}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    rows = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000) AS t")
    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) <= 9
