"""Creation of an empty mart: declared schemas and storage layout, as Parquet folders or as SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lumbung.plans.pipeline import sink_of, stored
from lumbung.schemas import LAYOUT, MART


def create_mart(spark: SparkSession, folder: str) -> list[str]:
    """Write an empty table for each that isn't there yet; the names of those made."""
    made = []
    for name, schema in MART.items():
        sink = sink_of(spark, folder, name)
        if not sink.exists():
            sink.partition_by = None  # an empty partitioned write leaves no schema behind
            sink.replace(stored(spark.createDataFrame([], schema), name))
            made.append(name)
    return made


def create_table_sql(name: str, folder: str) -> str:
    """The statement that registers a stored mart table in a catalogue."""
    by = LAYOUT[name][1]
    columns = [f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in MART[name]] + ([f"{by} {'bigint' if by == 'entity_block' else 'int'}"] if by else [])
    return f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(columns)}) USING parquet" + (f" PARTITIONED BY ({by})" if by else "") + f" LOCATION '{folder}/{name}.parquet'"
