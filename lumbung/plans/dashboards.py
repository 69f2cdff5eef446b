"""Dashboard questions and the filter lists behind them.

A dimension is joined only when a parameter needs it: dimension keys are unique, so a left join that
no filter reads changes nothing and Catalyst can't know that it may drop it. A filter on a dimension
makes the join an inner one. The tag filter is a semi join and never multiplies stock; stock by tag
counts the stock of an entity once for each of its tags, as the question asks.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F

from lumbung import functions as fn

#: The only information type that stock totals can answer.
STOCK_LEFT = "Sisa Stok"


@dataclass(frozen=True)
class Params:
    """Range of stock dates (inclusive) and optional filters; None means no filter."""

    date_from: date
    date_to: date
    activity_id: int | None = None
    material_type: str | None = None
    material_id: int | None = None
    tag_id: int | None = None
    province_id: str | None = None
    regency_id: str | None = None
    entity_type: str | None = None
    information_type: str | None = None


def _facts(mart: Mapping[str, DataFrame], p: Params) -> DataFrame:
    """Fact rows in range, with the filters that the fact's own columns carry, pushed to the scan."""
    fact = mart["fact_stock_snapshot"]
    rows = fact.where(F.col("stock_date").between(F.lit(p.date_from), F.lit(p.date_to)))
    if "stock_month" in fact.columns:  # partition column of the stored mart: prunes folders
        rows = rows.where(F.col("stock_month").between(p.date_from.year * 100 + p.date_from.month, p.date_to.year * 100 + p.date_to.month))
    if p.activity_id is not None:
        rows = rows.where(F.col("activity_id") == p.activity_id)
    if p.material_id is not None:
        rows = rows.where(F.col("material_id") == p.material_id)
    return rows


def _of_entities(rows: DataFrame, mart: Mapping[str, DataFrame], p: Params) -> DataFrame:
    wanted = {c: getattr(p, c) for c in ("province_id", "regency_id", "entity_type") if getattr(p, c) is not None}
    if not wanted:
        return rows
    entities = mart["dim_entity"]
    for c, v in wanted.items():
        entities = entities.where(F.col(c) == v)
    return rows.join(entities.select("entity_id"), "entity_id", "left_semi")


def _of_material_type(rows: DataFrame, mart: Mapping[str, DataFrame], p: Params) -> DataFrame:
    if p.material_type is None:
        return rows
    return rows.join(mart["dim_material"].where(F.col("category") == p.material_type).select("material_id"), "material_id", "left_semi")


def _tagged(rows: DataFrame, mart: Mapping[str, DataFrame], p: Params) -> DataFrame:
    if p.tag_id is None:
        return rows
    return rows.join(mart["bridge_entity_tag"].where(F.col("tag_id") == p.tag_id).select("entity_id"), "entity_id", "left_semi")


def total_stock(mart: Mapping[str, DataFrame], p: Params) -> DataFrame:
    """One row ``total_stock``; 0 if no row qualifies. Quantities that are no finite number add nothing."""
    rows = _tagged(_of_entities(_of_material_type(_facts(mart, p), mart, p), mart, p), mart, p)
    if p.information_type not in (None, STOCK_LEFT):
        rows = rows.where(F.lit(False))
    return rows.agg(F.coalesce(fn.exact_sum("stock_quantity"), F.lit(0.0)).alias("total_stock"))


def _stock_per_entity(rows: DataFrame, *more: str) -> DataFrame:
    """Partial sums per entity: a join to tags then multiplies entities, not fact rows."""
    return rows.groupBy("entity_id", *more).agg(F.sum(fn.exact_part("stock_quantity")).alias("qty"), F.sum(fn.rest_part("stock_quantity")).alias("rest"))


def stock_by_tag(mart: Mapping[str, DataFrame], p: Params) -> DataFrame:
    """Per tag ``tag_id, tag_name, entity_count, total_stock``, most stock first; ties by name and id.

    A pair that the bridge holds k times counts k times in the total, once in the entity count. Tags
    that don't resolve and entities without a tag don't show.
    """
    facts = _of_entities(_of_material_type(_facts(mart, p), mart, p), mart, p).where(F.col("entity_id").isNotNull())
    tags = mart["bridge_entity_tag"].select("entity_id", "tag_id")
    if p.tag_id is not None:
        tags = tags.where(F.col("tag_id") == p.tag_id)
    tags = tags.groupBy("entity_id", "tag_id").agg(F.count("*").alias("times"))
    return (
        _stock_per_entity(facts)
        .join(tags, "entity_id")
        .join(mart["dim_entity_tag"].select("tag_id", "tag_name"), "tag_id")
        .groupBy("tag_id", "tag_name")
        .agg(F.count("*").alias("entity_count"), fn.sum_of_parts(F.sum((F.col("qty") * F.col("times")).cast("decimal(38,6)")), F.sum(F.col("rest") * F.col("times"))).alias("total_stock"))
        .orderBy(F.desc_nulls_last("total_stock"), F.asc_nulls_last("tag_name"), "tag_id")
    )


def stock_by_material(mart: Mapping[str, DataFrame], p: Params) -> DataFrame:
    """Per material ``material_id, material_name, category, is_vaccine, entity_count, total_stock``, most stock first.

    Stock of materials without a dimension row doesn't show. The two-step count of entities (per
    entity and material, then per material) keeps a heavy material from one task.
    """
    facts = _tagged(_of_entities(_facts(mart, p), mart, p), mart, p)
    materials = mart["dim_material"].select("material_id", "material_name", "category", "is_vaccine")
    if p.material_type is not None:
        materials = materials.where(F.col("category") == p.material_type)
    per_material = _stock_per_entity(facts, "material_id").groupBy("material_id").agg(F.count("entity_id").alias("entity_count"), fn.sum_of_parts(F.sum("qty"), F.sum("rest")).alias("total_stock"))
    return (
        per_material.join(materials, "material_id")
        .select("material_id", "material_name", "category", "is_vaccine", "entity_count", "total_stock")
        .orderBy(F.desc_nulls_last("total_stock"), F.asc_nulls_last("material_name"), "material_id")
    )


def _list(df: DataFrame, *columns: str, by: str, distinct: bool = False) -> DataFrame:
    rows = df.select(*columns)
    rows = rows.distinct() if distinct else rows
    return rows.orderBy(F.asc_nulls_last(by), *(c for c in columns if c != by))


def filter_materials(mart: Mapping[str, DataFrame]) -> DataFrame:
    return _list(mart["dim_material"], "material_id", "material_name", "category", "is_vaccine", by="material_name")


def filter_activities(mart: Mapping[str, DataFrame]) -> DataFrame:
    return _list(mart["dim_activity"], "activity_id", "activity_name", by="activity_name")


def filter_tags(mart: Mapping[str, DataFrame]) -> DataFrame:
    return _list(mart["dim_entity_tag"], "tag_id", "tag_name", by="tag_name")


def filter_provinces(mart: Mapping[str, DataFrame]) -> DataFrame:
    return _list(mart["dim_location"], "province_id", "province_name", by="province_name", distinct=True)


def filter_regencies(mart: Mapping[str, DataFrame], province_id: str | None) -> DataFrame:
    """Regencies of a province; None gives no row."""
    return _list(mart["dim_location"].where(F.col("province_id") == F.lit(province_id)), "regency_id", "regency_name", by="regency_name", distinct=True)


def filter_entity_types(mart: Mapping[str, DataFrame]) -> DataFrame:
    return _list(mart["dim_entity"], "entity_type", by="entity_type", distinct=True)
