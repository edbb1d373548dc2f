"""Workers get the package when they can't import it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from helixmill.operators import lad
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
walks = spark.createDataFrame([("A", "h", 1)], "species string, hap_id string, node_id bigint")
depth = spark.createDataFrame([("A", 1, 3.0)], "species string, node_id bigint, depth double")
print("X", lad.fit_species(walks, depth).first().x)
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "X 3.0" in out.stdout, out.stderr[-2000:]
