"""The checkpoint fallback of sessions that set no shared folder."""

import subprocess
import sys
from pathlib import Path

PROBE = """
from tripwise.session import local_session, shared_dir, scratch_path, cut
spark = local_session(2, partitions=2, memory="1g", app="plain")
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_dir(spark) == shared_dir(spark)
assert cut(spark.range(5)).count() == 5
p = scratch_path(spark, "t")
spark.range(3).write.parquet(p)
assert spark.read.parquet(p).count() == 3
print("fine")
"""


def test_a_plain_local_session_falls_back(tmp_path):
    import os

    env = dict(os.environ, SPARK_CONF_DIR=str(tmp_path))
    run = subprocess.run([sys.executable, "-c", PROBE], cwd=Path(__file__).resolve().parents[1], env=env, capture_output=True, text=True, timeout=120)
    assert "fine" in run.stdout, run.stderr[-2000:]
