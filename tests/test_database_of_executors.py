"""A database that is read by processes other than the one that wrote it."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
RUN = """
import sys
from pyspark.sql import SparkSession
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.checkpoint.dir": "file://" + sys.argv[1], "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
from quarry.plans import records
print("rows", records.QUERIES["s10_database"](spark, sys.argv[2]).count())
"""


def test_executors_read_the_database(tmp_path, spark, sf_dir):
    env = os.environ | {"PYTHONPATH": str(REPO), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "SPARK_WORKER_DIR": str(tmp_path / "work"), "PYSPARK_SUBMIT_ARGS": "pyspark-shell"}
    shared = tmp_path / "shared"
    shared.mkdir()
    done = subprocess.run([sys.executable, "-c", RUN, str(shared), sf_dir], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=170)
    want = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 1000 and o_orderstatus <> 'P'").count()
    assert f"rows {want}" in done.stdout, done.stderr[-2000:]


def test_nulls_and_quotes_are_loaded(tmp_path, spark):
    from quarry.sources import readers, sinks

    rows = [(1, 'a "b", c', 1.5), (2, None, None), (3, "", -2.0), (4, "x\\y", 1e300)]
    url, options = sinks.database(spark.createDataFrame(rows, "k long, name string, v double"), f"file://{tmp_path}", "t", {"name": "VARCHAR(20)"})
    assert sorted(map(tuple, readers.jdbc_partitioned(spark, url, "t", "k", 3, **options).collect())) == rows
