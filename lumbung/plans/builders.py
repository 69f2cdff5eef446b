"""The nine mart tables as pure functions of the source tables.

Every builder is one lazy DataFrame plan. Small sides (provinces, regencies) are joined without a
hint, so the optimiser broadcasts them by their measured size and shuffles when they outgrow it.
Output columns and types are those of ``lumbung.schemas.MART``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumbung import functions as fn
from lumbung.schemas import MART, cast_to

CALENDAR = (date(2020, 1, 1), date(2030, 12, 31))


def dim_date(spark: SparkSession, first: date = CALENDAR[0], last: date = CALENDAR[1]) -> DataFrame:
    """One row per day from ``first`` to ``last``; week is the ISO week, weekend is Saturday and Sunday."""
    d = F.col("full_date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("full_date"))
    return cast_to(
        days.select(
            fn.date_key(d).alias("date_key"),
            d,
            F.year(d).alias("year"),
            F.quarter(d).alias("quarter"),
            F.month(d).alias("month"),
            F.date_format(d, "MMMM").alias("month_name"),
            F.date_format(d, "MMM").alias("month_short"),
            F.dayofmonth(d).alias("day"),
            F.date_format(d, "EEEE").alias("day_name"),
            F.date_format(d, "EEE").alias("day_short"),
            F.weekofyear(d).alias("week_of_year"),
            F.when(F.weekday(d) >= 5, 1).otherwise(0).alias("is_weekend"),
            d.cast("timestamp_ntz").alias("created_at"),
            d.cast("timestamp_ntz").alias("updated_at"),
        ),
        MART["dim_date"],
    )


def _alive(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def dim_location(t: Mapping[str, DataFrame], run_ts: datetime | None = None) -> DataFrame:
    """One row per regency that isn't deleted, with its province if that exists.

    A deleted province still names its regencies: the source marks deletions, but this table reads
    them of regencies only.
    """
    p = t["provinces"].select(F.col("id").alias("p_id"), F.col("name").alias("p_name"))
    province, regency = fn.or_unknown("p_name", "province"), fn.or_unknown("name", "regency")
    rows = (
        _alive(t["regencies"])
        .join(p, F.col("province_id") == F.col("p_id"), "left")
        .select(
            F.col("p_id").alias("province_id"),
            province.alias("province_name"),
            F.col("id").alias("regency_id"),
            regency.alias("regency_name"),
            fn.full_location(province, regency).alias("full_location"),
            "lat",
            "lng",
        )
        .distinct()
    )
    stamp = fn.run_stamp(run_ts)
    return cast_to(rows.withColumns({"created_at": stamp, "updated_at": stamp}), MART["dim_location"])


def dim_material(t: Mapping[str, DataFrame]) -> DataFrame:
    return cast_to(
        _alive(t["master_materials"]).select(
            F.col("id").alias("material_id"),
            F.col("code").alias("material_code"),
            fn.or_unknown("name", "material").alias("material_name"),
            fn.category("is_vaccine").alias("category"),
            fn.flag("is_vaccine").alias("is_vaccine"),
            "unit",
            "unit_of_distribution",
            "pieces_per_unit",
            fn.flag("temperature_sensitive").alias("temperature_sensitive"),
            "temperature_min",
            "temperature_max",
            fn.flag("status").alias("status"),
            "created_at",
            "updated_at",
        ),
        MART["dim_material"],
    )


def dim_entity(t: Mapping[str, DataFrame]) -> DataFrame:
    return cast_to(
        _alive(t["entities"]).select(
            F.col("id").alias("entity_id"),
            F.col("code").alias("entity_code"),
            fn.or_unknown("name", "entity").alias("entity_name"),
            fn.entity_type("type").alias("entity_type"),
            F.col("type").alias("type_code"),
            fn.flag("status").alias("status"),
            fn.or_default("is_puskesmas", 0).alias("is_puskesmas"),
            "province_id",
            "regency_id",
            "postal_code",
            fn.or_default("country", fn.DEFAULT_COUNTRY).alias("country"),
            "lat",
            "lng",
            "created_at",
            "updated_at",
        ),
        MART["dim_entity"],
    )


def dim_activity(t: Mapping[str, DataFrame]) -> DataFrame:
    flags = ("is_ordered_sales", "is_ordered_purchase", "is_patient_id")
    return cast_to(
        _alive(t["master_activities"]).select(
            F.col("id").alias("activity_id"),
            F.col("code").alias("activity_code"),
            fn.or_unknown("name", "activity").alias("activity_name"),
            *(fn.or_default(c, 0).alias(c) for c in flags),
            "created_at",
            "updated_at",
        ),
        MART["dim_activity"],
    )


def dim_entity_tag(t: Mapping[str, DataFrame]) -> DataFrame:
    return cast_to(_alive(t["entity_tags"]).select(F.col("id").alias("tag_id"), F.col("title").alias("tag_name"), "created_at", "updated_at"), MART["dim_entity_tag"])


def _deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with the first creation and the last update; null keys form groups of their own."""
    return df.groupBy(*keys).agg(F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def bridge_entity_tag(t: Mapping[str, DataFrame]) -> DataFrame:
    pairs = t["entity_entity_tags"].withColumnRenamed("entity_tag_id", "tag_id")
    return cast_to(_deduplicated(pairs, ["entity_id", "tag_id"]), MART["bridge_entity_tag"])


def bridge_entity_activity(t: Mapping[str, DataFrame]) -> DataFrame:
    return cast_to(_deduplicated(_alive(t["entity_activity_date"]), ["entity_id", "activity_id", "join_date", "end_date"]), MART["bridge_entity_activity"])


def fact_stock_snapshot(t: Mapping[str, DataFrame]) -> DataFrame:
    """One row per source stock record; batch, entity, material and place are null where the link dangles."""
    b = t["batches"].select(F.col("id").alias("b_id"), F.col("code").alias("batch_code"), F.to_date("expired_date").alias("batch_expired_date"))
    link = t["entity_has_master_materials"].select(F.col("id").alias("link_id"), "entity_id", F.col("master_material_id").alias("material_id"))
    e = t["entities"].select(F.col("id").alias("e_id"), "province_id", "regency_id")
    measures = {
        "qty": "stock_quantity",
        **{c: c for c in ("allocated", "in_transit", "open_vial", "extermination_discard_qty", "extermination_received_qty", "extermination_qty", "extermination_shipped_qty")},
    }
    joined = (
        t["stocks"]
        .join(b, F.col("batch_id") == F.col("b_id"), "left")
        .join(link, F.col("entity_has_material_id") == F.col("link_id"), "left")
        .join(e, F.col("entity_id") == F.col("e_id"), "left")
    )
    return cast_to(
        joined.select(
            F.col("id").alias("stock_id"),
            F.to_date("createdAt").alias("stock_date"),
            fn.date_key("createdAt").alias("date_key"),
            "batch_id",
            "batch_code",
            "batch_expired_date",
            "entity_id",
            "material_id",
            "activity_id",
            "province_id",
            "regency_id",
            *(fn.or_default(F.col(c).cast("double"), 0.0).alias(name) for c, name in measures.items()),
            "budget_source",
            F.col("year").alias("stock_year"),
            "price",
            "total_price",
            F.col("createdAt").alias("source_created_at"),
            F.col("updatedAt").alias("source_updated_at"),
        ),
        MART["fact_stock_snapshot"],
    )


#: Builders in load order: dimensions, bridges, fact.
BUILDERS: dict[str, Callable[[Mapping[str, DataFrame]], DataFrame]] = {
    f.__name__: f for f in (dim_location, dim_material, dim_entity, dim_activity, dim_entity_tag, bridge_entity_tag, bridge_entity_activity, fact_stock_snapshot)
}


def build(name: str, spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    return dim_date(spark) if name == "dim_date" else BUILDERS[name](tables)
