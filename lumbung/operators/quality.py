"""Checks of a mart after a load. Each gives a row ``check, table, violations``; 0 is good."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lumbung.operators.merge import duplicate_keys
from lumbung.schemas import KEYS, MART


def _result(df: DataFrame, check: str, table: str) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(check).alias("check"), F.lit(table).alias("table"), "violations")


def keys_unique(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    return _result(duplicate_keys(df, keys), f"unique({', '.join(keys)})", table)


def not_null(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Rows with a null in any of ``columns``."""
    anywhere = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns), F.lit(False))
    return _result(df.where(anywhere), f"not_null({', '.join(columns)})", table)


def references_resolve(df: DataFrame, table: str, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Non-null references without a parent row."""
    rows = df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")
    return _result(rows, f"references({column})", table)


REFERENCES = (
    ("fact_stock_snapshot", "entity_id", "dim_entity"),
    ("fact_stock_snapshot", "material_id", "dim_material"),
    ("fact_stock_snapshot", "activity_id", "dim_activity"),
    ("bridge_entity_tag", "tag_id", "dim_entity_tag"),
    ("bridge_entity_tag", "entity_id", "dim_entity"),
    ("bridge_entity_activity", "entity_id", "dim_entity"),
)


def check_mart(mart: Mapping[str, DataFrame], tables: Sequence[str]) -> DataFrame:
    """All checks of the given tables; references are checked where both sides are given."""
    out = []
    for name in tables:
        out.append(keys_unique(mart[name], name, KEYS[name]))
        out.append(not_null(mart[name], name, [f.name for f in MART[name] if not f.nullable]))
    for name, column, parent in REFERENCES:
        if name in tables and parent in tables:
            out.append(references_resolve(mart[name], name, column, mart[parent], KEYS[parent][0]))
    return reduce(DataFrame.unionByName, out)
