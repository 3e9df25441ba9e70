"""Python workers get their functions with the job, also where the package cannot be imported."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = f"""
import sys
sys.path.insert(0, {ROOT!r})
from webloom.operators import politeness
from webloom.session import build_session
from pyspark.sql import functions as F
spark = build_session("local[2]", spark__sql__shuffle__partitions="2")
df = spark.range(50).select(F.col("id").alias("arrival_id"), F.lit("d").alias("domain"), F.lit("u").alias("url"),
                            F.timestamp_seconds("id").alias("ts"))
print("admitted", politeness.admit(df, 10).filter("admitted").count())
"""


def test_without_package_on_the_worker_path(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", JOB], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300
    )
    assert "admitted 5" in done.stdout, done.stderr[-2000:]
