"""Declared schemas of the mart tables and the cast that enforces them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

_TYPES = {"int": IntegerType(), "long": LongType(), "double": DoubleType(), "string": StringType(), "date": DateType(), "ts": TimestampNTZType()}


def _schema(spec: str) -> StructType:
    """``name type`` pairs separated by commas; a trailing ``?`` on the type means nullable."""
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(StructField(name, _TYPES[kind.rstrip("?")], kind.endswith("?")))
    return StructType(fields)


STAMPS = ", created_at ts, updated_at ts"

MART: dict[str, StructType] = {
    "dim_date": _schema(
        "date_key int, full_date date, year int, quarter int, month int, month_name string, month_short string, day int, "
        "day_name string, day_short string, week_of_year int, is_weekend int" + STAMPS
    ),
    "dim_location": _schema(
        "province_id string?, province_name string, regency_id string, regency_name string, full_location string, lat string?, lng string?" + STAMPS
    ),
    "dim_material": _schema(
        "material_id int, material_code string?, material_name string, category string, is_vaccine int, unit string?, "
        "unit_of_distribution string?, pieces_per_unit double?, temperature_sensitive int, temperature_min double?, "
        "temperature_max double?, status int" + STAMPS
    ),
    "dim_entity": _schema(
        "entity_id int, entity_code string?, entity_name string, entity_type string, type_code int?, status int, is_puskesmas int, "
        "province_id string?, regency_id string?, postal_code string?, country string, lat string?, lng string?" + STAMPS
    ),
    "dim_activity": _schema("activity_id int, activity_code string?, activity_name string, is_ordered_sales int, is_ordered_purchase int, is_patient_id int" + STAMPS),
    "dim_entity_tag": _schema("tag_id int, tag_name string" + STAMPS),
    "bridge_entity_tag": _schema("entity_id int, tag_id int?" + STAMPS),
    "bridge_entity_activity": _schema("entity_id int?, activity_id int, join_date date?, end_date date?" + STAMPS),
    "fact_stock_snapshot": _schema(
        "stock_id long, stock_date date, date_key int, batch_id long?, batch_code string?, batch_expired_date date?, entity_id int?, "
        "material_id int?, activity_id int?, province_id string?, regency_id string?, stock_quantity double, allocated double, "
        "in_transit double, open_vial double, extermination_discard_qty double, extermination_received_qty double, "
        "extermination_qty double, extermination_shipped_qty double, budget_source int?, stock_year int?, price double?, "
        "total_price double?, source_created_at ts, source_updated_at ts"
    ),
}

#: Natural keys of the mart tables.
KEYS: dict[str, list[str]] = {
    "dim_date": ["date_key"],
    "dim_location": ["regency_id"],
    "dim_material": ["material_id"],
    "dim_entity": ["entity_id"],
    "dim_activity": ["activity_id"],
    "dim_entity_tag": ["tag_id"],
    "bridge_entity_tag": ["entity_id", "tag_id"],
    "bridge_entity_activity": ["entity_id", "activity_id", "join_date", "end_date"],
    "fact_stock_snapshot": ["stock_id"],
}

#: Sort order inside the files and partition column of each table in storage.
LAYOUT: dict[str, tuple[list[str], str | None]] = {
    "dim_date": (["date_key"], None),
    "dim_location": (["province_id", "regency_id"], None),
    "dim_material": (["material_id"], None),
    "dim_entity": (["entity_id"], "entity_block"),
    "dim_activity": (["activity_id"], None),
    "dim_entity_tag": (["tag_id"], None),
    "bridge_entity_tag": (["entity_id", "tag_id"], None),
    "bridge_entity_activity": (["entity_id", "activity_id"], None),
    "fact_stock_snapshot": (["stock_date", "province_id", "regency_id", "entity_id", "material_id", "activity_id", "stock_id"], "stock_month"),
}


def cast_to(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, in its order and types.

    A missing column is an error; extra columns are dropped; a value that doesn't fit raises (ANSI).
    """
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
