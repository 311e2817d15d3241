"""Queries run from a folder that does not hold the package, if it is shipped as the README says."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import shutil, sys
archive = shutil.make_archive({base!r}, "zip", {root!r}, "assayloom")
sys.path.insert(0, archive)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.addPyFile(archive)
import assayloom
assert assayloom.__file__.startswith(archive)
from assayloom.functions.udfs import p_t
df = spark.range(3).selectExpr("double(id) as t", "double(5) as df")
assert df.select(p_t("t", "df").alias("p")).count() == 3 and df.select(p_t("t", "df").alias("p")).first().p == 1.0
"""


def test_from_a_foreign_folder(tmp_path):
    code = SCRIPT.format(base=str(tmp_path / "assayloom"), root=ROOT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=120)
