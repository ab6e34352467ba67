"""Staged steps in a plain local session, where nothing names a shared folder."""

from __future__ import annotations

import os
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = """
from pyspark.sql import SparkSession
from reviewloom.staging import shared_dir, stage

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert sorted(r.id for r in stage(spark.range(5)).collect()) == [0, 1, 2, 3, 4]
assert shared_dir(spark) == shared_dir(spark.newSession())
"""


def test_a_local_session_without_settings_gets_a_folder_of_its_own(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": TOP}
    ran = subprocess.run([sys.executable, "-c", JOB], env=env, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]


def test_the_shared_folder_of_the_session_is_used(spark, tmp_path):
    from reviewloom.staging import shared_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named.rstrip("/")
