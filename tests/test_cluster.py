"""Queries where tasks run in other processes than the driver, as on a cluster, agree with SQL."""

import importlib.util
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from catalogue import reference
from compare import duck, rows_of, rows_of_sql
from lumbung.sources import jdbc

ON_CLUSTER = (
    "etl_over_jdbc",
    "sink_jdbc_overwrite",
    "sink_jdbc_whole",
    "source_jdbc_keys",
    "etl_to_database",
    "sink_jdbc_truncate",
    "source_jdbc_columns",
    "source_jdbc_query",
    "sink_jdbc_append",
    "sink_jdbc_upsert",
    "source_jdbc_count",
    "source_jdbc_split",
)

RUN = """
import json, os, sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
from compare import rows_of
home, out, sf, *names = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.checkpoint.dir": f"file://{home}/shared", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
for name in names:
    try:
        said = {"rows": repr(rows_of(entry.queries()[name](spark, sf)))}
    except Exception as e:
        said = {"error": str(e)[:2000]}
    with open(f"{out}/{name}.json", "w") as f:
        json.dump(said, f)
spark.stop()
"""


@pytest.fixture(scope="module")
def ran(sf, tmp_path_factory):
    """The folder of what each query gave on two executors."""
    home, out = tmp_path_factory.mktemp("home"), tmp_path_factory.mktemp("out")
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # executors work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    root = Path(entry.__file__).parent
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env |= {"SPARK_HOME": str(home), "PYTHONPATH": os.pathsep.join([str(root), f"{root}/tests", os.environ.get("PYTHONPATH", "")]), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_SUBMIT_ARGS": "--driver-memory 1g pyspark-shell"}
    subprocess.run([sys.executable, "-c", RUN, str(home), str(out), sf, *ON_CLUSTER], env=env, cwd=out, check=True, timeout=600)
    return out


@pytest.mark.parametrize("name", ON_CLUSTER)
def test_agrees_with_sql_on_a_cluster(ran, sf, name):
    said = json.loads((ran / f"{name}.json").read_text())
    assert "error" not in said, said["error"]
    assert said["rows"] == repr(rows_of_sql(duck(sf), entry.oracle_sql()[name]))


def test_the_driver_closes_a_database_that_is_read(spark, sf, monkeypatch):
    made, new = [], reference._database_url
    monkeypatch.setattr(jdbc, "is_local", lambda _: False)
    monkeypatch.setattr(reference, "_database_url", lambda: made.append(new()) or made[-1])
    got = entry.queries()["sink_jdbc_upsert"](spark, sf)
    folder = Path(made[0].removeprefix("jdbc:derby:").partition(";")[0])
    assert folder.is_dir() and not (folder / "db.lck").exists()  # it is there as long as the database is open
    assert repr(rows_of(got)) == repr(rows_of_sql(duck(sf), entry.oracle_sql()["sink_jdbc_upsert"]))
