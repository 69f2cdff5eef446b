"""The job runner: builds the mart tables in order and writes each by its method.

Dimensions and bridges come before the fact. The first failure ends the run. Row counts are observed
while the rows are written, so no plan runs twice.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from lumbung import functions as fn
from lumbung.operators.methods import METHODS, WriteStats, run_method
from lumbung.operators.quality import check_mart
from lumbung.operators.sinks import JdbcSink, ParquetSink
from lumbung.plans.builders import BUILDERS, build
from lumbung.schemas import KEYS, LAYOUT
from lumbung.sources.jdbc import Target, dialect, job_url, read_query, split_of
from lumbung.sources.tables import Tables


@dataclass(frozen=True)
class TableJob:
    name: str
    method: str = "overwrite"
    keys: tuple[str, ...] = ()


#: The mart in load order.
JOBS = tuple(TableJob(name) for name in ("dim_date", *BUILDERS))

SOURCES = ("provinces", "regencies", "master_materials", "entities", "master_activities", "entity_tags", "entity_entity_tags", "entity_activity_date", "entity_has_master_materials", "batches", "stocks")

#: Tasks that read the large source tables.
SPLITS = {"stocks": 16, "batches": 4}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the partition column of its storage layout, where it has one."""
    if name == "fact_stock_snapshot":
        return df.withColumn("stock_month", fn.month_key("stock_date"))
    if name == "dim_entity":
        return df.selectExpr("*", "entity_id div 100000 AS entity_block")
    return df


def sink_of(spark: SparkSession, folder: str, name: str) -> ParquetSink:
    sort, by = LAYOUT[name]
    return ParquetSink(spark, f"{folder}/{name}.parquet", sort, by)


def run(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str, jobs: Sequence[TableJob] = JOBS) -> dict[str, WriteStats]:
    """Build and write each job's table under ``folder``; the statistics by table."""
    done = {}
    for job in jobs:
        done[job.name] = run_method(stored(build(job.name, spark, tables), job.name), sink_of(spark, folder, job.name), job.method, list(job.keys) or None)
    return done


def run_to_database(spark: SparkSession, tables: Mapping[str, DataFrame], targets: Mapping[str, Target], jobs: Sequence[TableJob] = JOBS, connect: Callable[[], object] | None = None, **options: object) -> dict[str, WriteStats]:
    """Build each job's table and write it to its database table by its method; the statistics by table.

    ``options`` are those of ``run_method``, ``connect`` that of ``JdbcSink``.
    """
    return {job.name: run_method(build(job.name, spark, tables), JdbcSink(spark, targets[job.name], connect=connect), job.method, list(job.keys) or None, **options) for job in jobs}


def jdbc_tables(spark: SparkSession, url: str, user: str, password: str, splits: Mapping[str, int] = SPLITS, names: Sequence[str] = SOURCES) -> Tables:
    """The source tables (or some) as lazy scans; filters and columns are pushed into the database.

    Tables named in ``splits`` are read by so many tasks, in ranges of their id between its bounds.
    """
    out = {}
    for name in names:
        target = Target(url, name, user, password)
        split = split_of(spark, target, "id", splits[name]) if splits.get(name, 1) > 1 else None
        out[name] = read_query(spark, target, f"SELECT * FROM {name}", split)
    return Tables(spark, None, out)


def validate(spark: SparkSession, folder: str) -> DataFrame:
    """Quality checks over a stored mart."""
    return check_mart(Tables(spark, folder), [j.name for j in JOBS])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumbung", description="Build the stock mart from a MySQL database.")
    p.add_argument("--source_type", required=True, choices=["mysql"])
    p.add_argument("--target_type", required=True, choices=["clickhouse"])
    for side in ("source", "target"):
        for what in ("host", "port", "user", "db"):
            p.add_argument(f"--{side}_{what}", required=True)
        p.add_argument(f"--{side}_password", default=os.environ.get(f"{side.upper()}_PASSWORD"), help="or in the environment")
    p.add_argument("--method", default="overwrite", choices=sorted(METHODS), help="how every table is written")
    p.add_argument("--tables", nargs="*", choices=[j.name for j in JOBS], help="only these")
    p.add_argument("--batch_size", type=int, default=10_000)
    p.add_argument("--partitions", type=int, default=8, help="connections of a write")
    p.add_argument("--read_partitions", type=int, help="tasks that read a large table")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("stock_mart").getOrCreate()
    source = job_url(a.source_type, a.source_host, a.source_port, a.source_db)
    target = job_url(a.target_type, a.target_host, a.target_port, a.target_db)
    tables = jdbc_tables(spark, source, a.source_user, a.source_password, {name: a.read_partitions for name in SPLITS} if a.read_partitions else SPLITS)
    driver = dialect(a.target_type).driver
    jobs = [replace(j, method=a.method, keys=tuple(KEYS[j.name]) if a.method == "upsert" else ()) for j in JOBS if not a.tables or j.name in a.tables]
    targets = {j.name: Target(target, j.name, a.target_user, a.target_password, driver) for j in jobs}
    for name, stats in run_to_database(spark, tables, targets, jobs, batch_size=a.batch_size, partitions=a.partitions).items():
        print(f"{name}: {stats.as_dict()}")
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
