"""Queries of the mart itself: builders, dashboards, filter lists, expressions, joins, aggregates, writes.

Builders and write methods run on the operational tables (``adapter``); dashboards and filter
lists run on the delivered mart tables. SQL for checking stands beside each query.
"""

from __future__ import annotations

import atexit
import shutil
import sqlite3
import tempfile
from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from catalogue.adapter import AdaptedTables
from catalogue.adapter_sql import with_sources
from lumbung import functions as fn
from lumbung.operators import merge
from lumbung.operators.methods import run_method
from lumbung.operators.quality import REFERENCES, check_mart
from lumbung.operators.sinks import JdbcSink, ParquetSink, write_rows
from lumbung.operators.upsert_sql import upsert_sql
from lumbung.plans import builders, dashboards as dash, ddl, pipeline
from lumbung.schemas import KEYS, MART
from lumbung.session import hadoop_path, work_folder
from lumbung.sources import jdbc
from lumbung.sources.tables import Tables
from lumbung.streaming import upsert_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


# --- builders -------------------------------------------------------------------------------------

#: Columns left out of a check: the time of the run.
_UNCHECKED = {"dim_location": ("created_at", "updated_at")}


def _built(name: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return builders.build(name, spark, AdaptedTables(spark, d)).drop(*_UNCHECKED.get(name, ()))

    return query


_TYPE_SQL = "CASE type " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fn.ENTITY_TYPES.items()) + f" ELSE '{fn.OTHER_ENTITY_TYPE}' END"
_LOCATION_SQL = "coalesce(p.name, 'Unknown Province')", "coalesce(r.name, 'Unknown Regency')"
_MEASURES = ("allocated", "in_transit", "open_vial", "extermination_discard_qty", "extermination_received_qty", "extermination_qty", "extermination_shipped_qty")

_BUILDER_SQL = {
    "dim_date": """SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, d AS full_date, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month,
  strftime(d, '%B') AS month_name, strftime(d, '%b') AS month_short, CAST(day(d) AS INT) AS day, strftime(d, '%A') AS day_name, strftime(d, '%a') AS day_short, CAST(weekofyear(d) AS INT) AS week_of_year,
  CASE WHEN isodow(d) > 5 THEN 1 ELSE 0 END AS is_weekend, CAST(d AS TIMESTAMP) AS created_at, CAST(d AS TIMESTAMP) AS updated_at
FROM (SELECT CAST(unnest(generate_series(DATE '2020-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS DATE) AS d)""",
    "dim_location": with_sources(f"""SELECT DISTINCT p.id AS province_id, {_LOCATION_SQL[0]} AS province_name, r.id AS regency_id, {_LOCATION_SQL[1]} AS regency_name,
  {_LOCATION_SQL[0]} || ' - ' || {_LOCATION_SQL[1]} AS full_location, r.lat, r.lng FROM regencies r LEFT JOIN provinces p ON p.id = r.province_id WHERE r.deleted_at IS NULL""", "provinces", "regencies"),
    "dim_material": with_sources("""SELECT id AS material_id, code AS material_code, coalesce(name, 'Unknown Material') AS material_name, if(is_vaccine = 1, 'Vaccine', 'Non-Vaccine') AS category,
  if(is_vaccine = 1, 1, 0) AS is_vaccine, unit, unit_of_distribution, pieces_per_unit, if(temperature_sensitive = 1, 1, 0) AS temperature_sensitive, temperature_min, temperature_max, if(status = 1, 1, 0) AS status, created_at, updated_at
FROM master_materials WHERE deleted_at IS NULL""", "master_materials"),
    "dim_entity": with_sources(f"""SELECT id AS entity_id, code AS entity_code, coalesce(name, 'Unknown Facility') AS entity_name, {_TYPE_SQL} AS entity_type, type AS type_code, if(status = 1, 1, 0) AS status,
  coalesce(is_puskesmas, 0) AS is_puskesmas, province_id, regency_id, postal_code, coalesce(country, 'Indonesia') AS country, lat, lng, created_at, updated_at FROM entities WHERE deleted_at IS NULL""", "entities"),
    "dim_activity": with_sources("""SELECT id AS activity_id, code AS activity_code, coalesce(name, 'Unknown Activity') AS activity_name, coalesce(is_ordered_sales, 0) AS is_ordered_sales,
  coalesce(is_ordered_purchase, 0) AS is_ordered_purchase, coalesce(is_patient_id, 0) AS is_patient_id, created_at, updated_at FROM master_activities WHERE deleted_at IS NULL""", "master_activities"),
    "dim_entity_tag": with_sources("SELECT id AS tag_id, title AS tag_name, created_at, updated_at FROM entity_tags WHERE deleted_at IS NULL", "entity_tags"),
    "bridge_entity_tag": with_sources("SELECT entity_id, entity_tag_id AS tag_id, min(created_at) AS created_at, max(updated_at) AS updated_at FROM entity_entity_tags GROUP BY ALL", "entity_entity_tags"),
    "bridge_entity_activity": with_sources("SELECT entity_id, activity_id, join_date, end_date, min(created_at) AS created_at, max(updated_at) AS updated_at FROM entity_activity_date WHERE deleted_at IS NULL GROUP BY ALL", "entity_activity_date"),
}
_FACT_SOURCES = ("stocks", "batches", "entity_has_master_materials", "entities")
_FACT_FROM = "FROM stocks s LEFT JOIN batches b ON b.id = s.batch_id LEFT JOIN entity_has_master_materials m ON m.id = s.entity_has_material_id LEFT JOIN entities e ON e.id = m.entity_id"
_FACT_SELECT = f"""SELECT s.id AS stock_id, CAST(s.createdAt AS DATE) AS stock_date, CAST(strftime(s.createdAt, '%Y%m%d') AS INT) AS date_key, s.batch_id, b.code AS batch_code, CAST(b.expired_date AS DATE) AS batch_expired_date,
  m.entity_id, m.master_material_id AS material_id, s.activity_id, e.province_id, e.regency_id, coalesce(s.qty, 0) AS stock_quantity, {", ".join(f"CAST(coalesce(s.{c}, 0) AS DOUBLE) AS {c}" for c in _MEASURES)},
  s.budget_source, s.year AS stock_year, s.price, s.total_price, s.createdAt AS source_created_at, s.updatedAt AS source_updated_at {_FACT_FROM}"""
_BUILDER_SQL["fact_stock_snapshot"] = with_sources(_FACT_SELECT, *_FACT_SOURCES)

for _name, _sql in _BUILDER_SQL.items():
    _register(f"build_{_name}", _built(_name), _sql)


# --- end to end -----------------------------------------------------------------------------------


def built_mart(spark: SparkSession, d: str) -> Tables:
    """The mart over the operational tables, every table a lazy plan."""
    t = AdaptedTables(spark, d)
    return Tables(spark, None, {name: builders.build(name, spark, t) for name in ("dim_date", *builders.BUILDERS)})


#: The whole time that the operational tables span, and the calendar's, which the delivered mart lies in.
_ETL_RANGE = dash.Params(date(1990, 1, 1), date(2030, 12, 31))


def etl_total_stock(spark: SparkSession, d: str) -> DataFrame:
    return dash.total_stock(built_mart(spark, d), _ETL_RANGE)


def etl_stock_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return dash.stock_by_tag(built_mart(spark, d), _ETL_RANGE)


def etl_stock_by_material(spark: SparkSession, d: str) -> DataFrame:
    return dash.stock_by_material(built_mart(spark, d), _ETL_RANGE)


_IN_RANGE = "stock_date BETWEEN DATE '1990-01-01' AND DATE '2030-12-31'"
_BUILT_FACT = f"(SELECT * FROM ({_FACT_SELECT}) WHERE {_IN_RANGE}) f"
_register("etl_total_stock", etl_total_stock, with_sources(f"SELECT coalesce(sum(stock_quantity), 0) AS total_stock FROM {_BUILT_FACT}", *_FACT_SOURCES))
_register("etl_stock_by_tag", etl_stock_by_tag, with_sources(
    f"""SELECT g.id AS tag_id, g.title AS tag_name, count(DISTINCT f.entity_id) AS entity_count, sum(f.stock_quantity) AS total_stock FROM {_BUILT_FACT}
JOIN (SELECT DISTINCT entity_id, entity_tag_id FROM entity_entity_tags) t ON t.entity_id = f.entity_id JOIN entity_tags g ON g.id = t.entity_tag_id WHERE g.deleted_at IS NULL GROUP BY ALL""",
    *_FACT_SOURCES, "entity_entity_tags", "entity_tags"))
_register("etl_stock_by_material", etl_stock_by_material, with_sources(
    f"""SELECT m.id AS material_id, coalesce(m.name, 'Unknown Material') AS material_name, if(m.is_vaccine = 1, 'Vaccine', 'Non-Vaccine') AS category, m.is_vaccine, count(DISTINCT f.entity_id) AS entity_count, sum(f.stock_quantity) AS total_stock
FROM {_BUILT_FACT} JOIN master_materials m ON m.id = f.material_id WHERE m.deleted_at IS NULL GROUP BY ALL""", *_FACT_SOURCES, "master_materials"))  # fmt: skip


# --- dashboards on the delivered mart -------------------------------------------------------------

_ALL = dash.Params(date(2020, 1, 1), date(2030, 12, 31))
_VARIANTS: dict[str, dict[str, object]] = {
    "all": {},
    "year": {"date_from": date(2023, 7, 1), "date_to": date(2024, 6, 30)},
    "activity": {"activity_id": 3},
    "material_type": {"material_type": "Vaccine"},
    "material": {"material_id": 16},
    "tag": {"tag_id": 5},
    "province": {"province_id": "24"},
    "regency": {"regency_id": "2406"},
    "entity_type": {"entity_type": "Puskesmas"},
    "combo": {"activity_id": 3, "material_type": "Vaccine", "tag_id": 5, "province_id": "24"},
    "empty": {"date_from": date(2031, 1, 1), "date_to": date(2031, 12, 31)},
}
#: Decimals where they reach, doubles beyond; null without a finite value.
_FINITE_SUM = """CASE WHEN count(*) FILTER (isfinite(f.stock_quantity)) > 0 THEN coalesce(CAST(sum(CASE WHEN isfinite(f.stock_quantity) AND abs(f.stock_quantity) < 1e22 THEN CAST(f.stock_quantity AS DECIMAL(28, 6)) END) AS DOUBLE), 0)
  + coalesce(sum(CASE WHEN isfinite(f.stock_quantity) AND abs(f.stock_quantity) >= 1e22 THEN f.stock_quantity END), 0) END"""


def _where_sql(p: dash.Params, tag: str) -> str:
    out = [f"f.stock_date BETWEEN DATE '{p.date_from}' AND DATE '{p.date_to}'"]
    for c, side in (("activity_id", "f"), ("material_id", "f"), ("province_id", "e"), ("regency_id", "e"), ("entity_type", "e")):
        v = getattr(p, c)
        if v is not None:
            out.append(f"{side}.{c} = " + (f"'{v}'" if isinstance(v, str) else str(v)))
    if p.material_type is not None:
        out.append(f"m.category = '{p.material_type}'")
    if p.tag_id is not None:
        out.append(tag.format(p.tag_id))
    if p.information_type not in (None, dash.STOCK_LEFT):
        out.append("1 = 0")
    return " AND ".join(out)


_TAGGED_SQL = "EXISTS (SELECT 1 FROM bridge_entity_tag b WHERE b.entity_id = f.entity_id AND b.tag_id = {})"
_TOTAL_SQL = f"SELECT coalesce({_FINITE_SUM}, 0) AS total_stock FROM fact_stock_snapshot f LEFT JOIN dim_material m USING (material_id) LEFT JOIN dim_entity e ON e.entity_id = f.entity_id WHERE "
_BY_TAG_SQL = f"""SELECT g.tag_id, g.tag_name, count(DISTINCT f.entity_id) AS entity_count, {_FINITE_SUM} AS total_stock FROM fact_stock_snapshot f JOIN bridge_entity_tag b ON b.entity_id = f.entity_id
JOIN dim_entity_tag g ON g.tag_id = b.tag_id LEFT JOIN dim_material m ON m.material_id = f.material_id LEFT JOIN dim_entity e ON e.entity_id = f.entity_id WHERE """
_BY_MATERIAL_SQL = f"""SELECT m.material_id, m.material_name, m.category, m.is_vaccine, count(DISTINCT f.entity_id) AS entity_count, {_FINITE_SUM} AS total_stock
FROM fact_stock_snapshot f JOIN dim_material m ON m.material_id = f.material_id LEFT JOIN dim_entity e ON e.entity_id = f.entity_id WHERE """


def _dashboard(question: Callable, p: dash.Params) -> Query:
    return lambda spark, d: question(Tables(spark, d), p)


for _name, _change in [*_VARIANTS.items(), ("info_ok", {"information_type": dash.STOCK_LEFT}), ("info_other", {"information_type": "Kedaluwarsa"})]:
    _p = replace(_ALL, **_change)
    _register(f"total_stock_{_name}", _dashboard(dash.total_stock, _p), _TOTAL_SQL + _where_sql(_p, _TAGGED_SQL))
    if _name in _VARIANTS:
        _register(f"stock_by_tag_{_name}", _dashboard(dash.stock_by_tag, _p), _BY_TAG_SQL + _where_sql(_p, "b.tag_id = {}") + " GROUP BY g.tag_id, g.tag_name")
        _register(f"stock_by_material_{_name}", _dashboard(dash.stock_by_material, _p), _BY_MATERIAL_SQL + _where_sql(_p, _TAGGED_SQL) + " GROUP BY m.material_id, m.material_name, m.category, m.is_vaccine")

for _name, _question, _sql in (
    ("filter_materials", dash.filter_materials, "SELECT material_id, material_name, category, is_vaccine FROM dim_material"),
    ("filter_activities", dash.filter_activities, "SELECT activity_id, activity_name FROM dim_activity"),
    ("filter_tags", dash.filter_tags, "SELECT tag_id, tag_name FROM dim_entity_tag"),
    ("filter_provinces", dash.filter_provinces, "SELECT DISTINCT province_id, province_name FROM dim_location"),
    ("filter_regencies", lambda mart: dash.filter_regencies(mart, "24"), "SELECT DISTINCT regency_id, regency_name FROM dim_location WHERE province_id = '24'"),
    ("filter_entity_types", dash.filter_entity_types, "SELECT DISTINCT entity_type FROM dim_entity"),
):
    _register(_name, lambda spark, d, q=_question: q(Tables(spark, d)), _sql)


# --- expressions ----------------------------------------------------------------------------------


def _expression(table: str, *columns: str | Callable) -> Query:
    return lambda spark, d: AdaptedTables(spark, d)[table].select(*(c if isinstance(c, str) else c() for c in columns))


for _name, _table, _columns, _sql in (
    ("expr_coalesce_default", "entities", ("id", lambda: fn.or_unknown("name", "entity").alias("name"), lambda: fn.or_default("is_puskesmas", 0).alias("is_puskesmas"), lambda: fn.or_default("country", fn.DEFAULT_COUNTRY).alias("country")),
     "SELECT id, coalesce(name, 'Unknown Facility') AS name, coalesce(is_puskesmas, 0) AS is_puskesmas, coalesce(country, 'Indonesia') AS country FROM entities"),
    ("expr_concat_location", "regencies", ("id", lambda: fn.full_location(fn.or_default("province_id", "-"), fn.or_unknown("name", "regency")).alias("place")),
     "SELECT id, coalesce(province_id, '-') || ' - ' || coalesce(name, 'Unknown Regency') AS place FROM regencies"),
    ("expr_case_category", "master_materials", ("id", lambda: fn.category("is_vaccine").alias("category")), "SELECT id, CASE is_vaccine WHEN 1 THEN 'Vaccine' ELSE 'Non-Vaccine' END AS category FROM master_materials"),
    ("expr_case_entity_type", "entities", ("id", lambda: fn.entity_type("type").alias("entity_type")), f"SELECT id, {_TYPE_SQL} AS entity_type FROM entities"),
    ("expr_flag_normalise", "master_materials", ("id", lambda: fn.flag("temperature_sensitive").alias("sensitive"), lambda: fn.flag("status").alias("status")),
     "SELECT id, CAST(coalesce(temperature_sensitive = 1, false) AS INT) AS sensitive, CAST(coalesce(status = 1, false) AS INT) AS status FROM master_materials"),
    ("expr_to_date", "batches", ("id", lambda: F.to_date("expired_date").alias("day")), "SELECT id, CAST(expired_date AS DATE) AS day FROM batches"),
    ("expr_date_key", "batches", ("id", lambda: fn.date_key("expired_date").alias("date_key"), lambda: fn.month_key("expired_date").alias("month_key")),
     "SELECT id, CAST(strftime(expired_date, '%Y%m%d') AS INT) AS date_key, CAST(strftime(expired_date, '%Y%m') AS INT) AS month_key FROM batches"),
    ("expr_iso_week", "batches", ("id", lambda: F.weekofyear("expired_date").alias("week"), lambda: F.when(F.weekday("expired_date") >= 5, 1).otherwise(0).alias("is_weekend")),
     "SELECT id, CAST(weekofyear(expired_date) AS INT) AS week, CASE WHEN isodow(expired_date) > 5 THEN 1 ELSE 0 END AS is_weekend FROM batches"),
    ("expr_month_day_names", "batches", ("id", lambda: F.date_format("expired_date", "MMMM").alias("month_name"), lambda: F.date_format("expired_date", "MMM").alias("month_short"), lambda: F.date_format("expired_date", "EEEE").alias("day_name"), lambda: F.date_format("expired_date", "EEE").alias("day_short")),
     "SELECT id, strftime(expired_date, '%B') AS month_name, strftime(expired_date, '%b') AS month_short, strftime(expired_date, '%A') AS day_name, strftime(expired_date, '%a') AS day_short FROM batches"),
):
    _register(_name, _expression(_table, *_columns), with_sources(_sql, _table))


_DIGESTED = ["id", "name", "type", "country"]
_register("expr_text_digest", _expression("entities", "id", lambda: fn.text_digest(_DIGESTED).alias("digest")), with_sources("SELECT id, md5(concat_ws('||', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in _DIGESTED) + ")) AS digest FROM entities", "entities"))


# --- joins and aggregates -------------------------------------------------------------------------


def join_left_chain(spark: SparkSession, d: str) -> DataFrame:
    return builders.fact_stock_snapshot(AdaptedTables(spark, d)).select("stock_id", "batch_code", "entity_id", "material_id", "province_id")


def join_left_unmatched(spark: SparkSession, d: str) -> DataFrame:
    rows = builders.fact_stock_snapshot(AdaptedTables(spark, d))
    return rows.agg(*(F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("batch_code", "entity_id", "province_id")))


def join_inner_bridge_fanout(spark: SparkSession, d: str) -> DataFrame:
    m = Tables(spark, d)
    return m["fact_stock_snapshot"].join(m["bridge_entity_tag"].select("entity_id", "tag_id"), "entity_id").join(m["dim_entity_tag"], "tag_id").groupBy("tag_id").agg(F.count("*").alias("n_rows"))


def join_left_semi_tag(spark: SparkSession, d: str) -> DataFrame:
    m = Tables(spark, d)
    return m["dim_entity"].join(m["bridge_entity_tag"].where("tag_id = 5"), "entity_id", "left_semi").select("entity_id")


def join_left_anti_key(spark: SparkSession, d: str) -> DataFrame:
    m = Tables(spark, d)
    return m["dim_entity"].join(m["bridge_entity_tag"], "entity_id", "left_anti").select("entity_id")


def join_exists_or(spark: SparkSession, d: str) -> DataFrame:
    m = Tables(spark, d)
    m["dim_entity"].createOrReplaceTempView("join_exists_entity")
    m["bridge_entity_tag"].createOrReplaceTempView("join_exists_tag")
    return spark.sql(
        "SELECT entity_id FROM join_exists_entity e WHERE status = 0 OR EXISTS (SELECT 1 FROM join_exists_tag b WHERE b.entity_id = e.entity_id AND b.tag_id = :tag)", args={"tag": 5}
    )


def agg_min_max_dedup(spark: SparkSession, d: str) -> DataFrame:
    return builders._deduplicated(Tables(spark, d)["bridge_entity_tag"], ["entity_id", "tag_id"])


def agg_nullable_group(spark: SparkSession, d: str) -> DataFrame:
    return builders._deduplicated(Tables(spark, d)["bridge_entity_activity"], ["entity_id", "activity_id", "join_date", "end_date"])


def agg_sum(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d)["fact_stock_snapshot"].groupBy("activity_id").agg(fn.exact_sum("stock_quantity").alias("total_stock"))


def agg_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d)["fact_stock_snapshot"].groupBy("activity_id").agg(F.countDistinct("entity_id").alias("entity_count"))


def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d)["dim_entity"].select("province_id", "entity_type").distinct()


def agg_count(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d)["fact_stock_snapshot"].agg(F.count("*").alias("n_rows"))


for _q, _sql in (
    (join_left_chain, with_sources(f"SELECT s.id AS stock_id, b.code AS batch_code, m.entity_id, m.master_material_id AS material_id, e.province_id {_FACT_FROM}", *_FACT_SOURCES)),
    (join_left_unmatched, with_sources(f"SELECT count(*) - count(b.code) AS no_batch_code, count(*) - count(m.entity_id) AS no_entity_id, count(*) - count(e.province_id) AS no_province_id {_FACT_FROM}", *_FACT_SOURCES)),
    (join_inner_bridge_fanout, "SELECT tag_id, count(*) AS n_rows FROM fact_stock_snapshot JOIN bridge_entity_tag USING (entity_id) JOIN dim_entity_tag USING (tag_id) GROUP BY tag_id"),
    (join_left_semi_tag, "SELECT entity_id FROM dim_entity WHERE entity_id IN (SELECT entity_id FROM bridge_entity_tag WHERE tag_id = 5)"),
    (join_left_anti_key, "SELECT entity_id FROM dim_entity WHERE entity_id NOT IN (SELECT entity_id FROM bridge_entity_tag WHERE entity_id IS NOT NULL)"),
    (join_exists_or, "SELECT entity_id FROM dim_entity WHERE status = 0 OR entity_id IN (SELECT entity_id FROM bridge_entity_tag WHERE tag_id = 5)"),
    (agg_min_max_dedup, "SELECT entity_id, tag_id, min(created_at) AS created_at, max(updated_at) AS updated_at FROM bridge_entity_tag GROUP BY ALL"),
    (agg_nullable_group, "SELECT entity_id, activity_id, join_date, end_date, min(created_at) AS created_at, max(updated_at) AS updated_at FROM bridge_entity_activity GROUP BY ALL"),
    (agg_sum, f"SELECT activity_id, {_FINITE_SUM} AS total_stock FROM fact_stock_snapshot f GROUP BY activity_id"),
    (agg_count_distinct, "SELECT activity_id, count(DISTINCT entity_id) AS entity_count FROM fact_stock_snapshot GROUP BY activity_id"),
    (agg_distinct, "SELECT DISTINCT province_id, entity_type FROM dim_entity"),
    (agg_count, "SELECT count(*) AS n_rows FROM fact_stock_snapshot"),
):
    _register(_q.__name__, _q, _sql)


# --- writes ---------------------------------------------------------------------------------------
# The target is the delivered table of facilities as it was before the last two deliveries; the
# source is the whole table, with the names of the facilities of delivery 2 changed.

_NOW_SQL = "now_rows AS (SELECT entity_id, CASE WHEN load_no = 2 THEN entity_name || ' *' ELSE entity_name END AS entity_name, entity_type, province_id, status, load_no, updated_at FROM dim_entity)"
_OLD_SQL = "old_rows AS (SELECT entity_id, entity_name, entity_type, province_id, status, load_no, updated_at FROM dim_entity WHERE load_no <= 4)"
_WRITE_COLUMNS = ("entity_id", "entity_name", "entity_type", "province_id", "status", "load_no", "updated_at")


def _source(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("load_no") == 2, F.concat("entity_name", F.lit(" *"))).otherwise(F.col("entity_name"))
    return Tables(spark, d)["dim_entity"].withColumn("entity_name", name).select(*_WRITE_COLUMNS)


def _target(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d)["dim_entity"].where("load_no <= 4").select(*_WRITE_COLUMNS)


def _changes(*kinds: str) -> Query:
    return lambda spark, d: merge.compare(_source(spark, d), _target(spark, d), ["entity_id"]).of(*kinds)


def upsert_merged(spark: SparkSession, d: str) -> DataFrame:
    return merge.merged(_source(spark, d), _target(spark, d), ["entity_id"])


def upsert_keyless_new(spark: SparkSession, d: str) -> DataFrame:
    return merge.missing_rows(_source(spark, d), _target(spark, d))


def _written(method: str, empty: bool = False, keys: list[str] | None = None) -> Query:
    """The table after a write; the folder lies in the shared folder of the cluster."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        sink = ParquetSink(spark, f"{work_folder(spark, method)}/t")
        sink.replace(_target(spark, d))
        run_method(_source(spark, d).where(F.lit(not empty)), sink, method, keys)
        return sink.read()

    return query


_register("upsert_new", _changes("new"), f"WITH {_NOW_SQL}, {_OLD_SQL} SELECT * FROM now_rows WHERE entity_id NOT IN (SELECT entity_id FROM old_rows)")
_register("upsert_changed", _changes("changed"), f"WITH {_NOW_SQL}, {_OLD_SQL} SELECT n.* FROM now_rows n JOIN old_rows o USING (entity_id) WHERE n.entity_name <> o.entity_name")
_register("upsert_unchanged", _changes("unchanged"), f"WITH {_NOW_SQL}, {_OLD_SQL} SELECT n.* FROM now_rows n JOIN old_rows o USING (entity_id) WHERE n.entity_name = o.entity_name")
_register("upsert_merged", upsert_merged, f"WITH {_NOW_SQL} SELECT * FROM now_rows")
_register("upsert_keyless_new", upsert_keyless_new, f"WITH {_NOW_SQL}, {_OLD_SQL} SELECT * FROM now_rows EXCEPT SELECT * FROM old_rows")
_register("write_append_result", _written("append"), f"WITH {_NOW_SQL}, {_OLD_SQL} SELECT * FROM now_rows UNION ALL SELECT * FROM old_rows")
_register("write_overwrite_result", _written("overwrite"), f"WITH {_NOW_SQL} SELECT * FROM now_rows")
_register("write_truncate_result", _written("truncate", empty=True), f"WITH {_OLD_SQL} SELECT * FROM old_rows WHERE 1 = 0")
_register("write_overwrite_empty_noop", _written("overwrite", empty=True), f"WITH {_OLD_SQL} SELECT * FROM old_rows")
_register("write_upsert_result", _written("upsert", keys=["entity_id"]), f"WITH {_NOW_SQL} SELECT * FROM now_rows")


def write_statistics(spark: SparkSession, d: str) -> DataFrame:
    """What each method says that it did, run one after the other on the same table."""
    sink = ParquetSink(spark, f"{work_folder(spark, 'stats')}/t")
    sink.replace(_target(spark, d))
    steps = [("upsert", ["entity_id"]), ("upsert again", ["entity_id"]), ("append", None), ("overwrite", None), ("truncate", None)]
    found = [(name, k, int(v)) for name, keys in steps for k, v in run_method(_source(spark, d), sink, name.split()[0], keys).as_dict().items()]
    return spark.createDataFrame(found, "method string, metric string, value long")


def upsert_ignores_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Columns that differ on every run don't make a row changed."""
    source = _source(spark, d).withColumn("updated_at", F.expr("updated_at + INTERVAL 1 DAY"))
    return merge.compare(source, _target(spark, d), ["entity_id"]).of("unchanged").select("entity_id")


def storage_layout(spark: SparkSession, d: str) -> DataFrame:
    """Rows per month partition of the stored fact, and rows that stand before one of an earlier day in their file."""
    sink = pipeline.sink_of(spark, work_folder(spark, "layout"), "fact_stock_snapshot")
    sink.replace(pipeline.stored(Tables(spark, d)["fact_stock_snapshot"], "fact_stock_snapshot"))
    rows = sink.read().select("stock_month", "stock_date", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    late = rows.withColumn("before", F.lag("stock_date").over(Window.partitionBy("f").orderBy("i")))
    return late.groupBy("stock_month").agg(F.count("*").alias("n_rows"), F.count_if(F.col("before") > F.col("stock_date")).alias("out_of_order"))


def ddl_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns and types of the empty mart as it is created."""
    folder = work_folder(spark, "ddl")
    ddl.create_mart(spark, folder)
    found = [(t, c, kind) for t in MART if t != "dim_date" for c, kind in Tables(spark, folder)[t].drop("stock_month", "entity_block").dtypes]
    return spark.createDataFrame(found, "in_table string, in_field string, kind string")


def runner_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every table after a run of all jobs."""
    folder = work_folder(spark, "mart")
    pipeline.run(spark, AdaptedTables(spark, d), folder)
    built = Tables(spark, folder)
    return reduce(DataFrame.unionByName, (built[j.name].agg(F.count("*").alias("n_rows")).select(F.lit(j.name).alias("in_table"), "n_rows") for j in pipeline.JOBS))


def expr_run_stamp(spark: SparkSession, d: str) -> DataFrame:
    return AdaptedTables(spark, d)["regencies"].select("id", fn.run_stamp(datetime(2024, 5, 6, 7, 8, 9)).alias("stamp"))


_STATS_SQL = f"""WITH {_NOW_SQL}, {_OLD_SQL}, n AS (SELECT (SELECT count(*) FROM now_rows) AS s, (SELECT count(*) FROM old_rows) AS t,
  (SELECT count(*) FROM now_rows JOIN old_rows USING (entity_id)) AS e, (SELECT count(*) FROM now_rows n JOIN old_rows o USING (entity_id) WHERE n.entity_name <> o.entity_name) AS c)
SELECT x.* FROM n, LATERAL (VALUES
  ('upsert', 'source_count', s), ('upsert', 'count_before', t), ('upsert', 'count_after', s), ('upsert', 'processed', s - e + c), ('upsert', 'inserted', s - e), ('upsert', 'updated', c), ('upsert', 'skipped', e - c),
  ('upsert', 'new_rows', s - e), ('upsert', 'existing_rows', e), ('upsert', 'changed_rows', c), ('upsert', 'success', s - e + c), ('upsert', 'failed', 0),
  ('upsert again', 'source_count', s), ('upsert again', 'count_before', s), ('upsert again', 'count_after', s), ('upsert again', 'processed', 0), ('upsert again', 'inserted', 0), ('upsert again', 'updated', 0), ('upsert again', 'skipped', s),
  ('upsert again', 'new_rows', 0), ('upsert again', 'existing_rows', s), ('upsert again', 'changed_rows', 0), ('upsert again', 'success', 0), ('upsert again', 'failed', 0),
  ('append', 'source_count', s), ('append', 'count_before', s), ('append', 'count_after', 2 * s), ('append', 'processed', s), ('append', 'inserted', s), ('append', 'failed', 0),
  ('overwrite', 'source_count', s), ('overwrite', 'count_before', 2 * s), ('overwrite', 'count_after', s), ('overwrite', 'processed', s), ('overwrite', 'inserted', s), ('overwrite', 'failed', 0),
  ('truncate', 'source_count', s), ('truncate', 'count_before', s), ('truncate', 'count_after', s), ('truncate', 'processed', s), ('truncate', 'inserted', s), ('truncate', 'failed', 0), ('truncate', 'truncated', 1)) x(method, metric, value)"""

for _q, _sql in (
    (write_statistics, _STATS_SQL),
    (upsert_ignores_stamps, f"WITH {_NOW_SQL}, {_OLD_SQL} SELECT entity_id FROM now_rows n JOIN old_rows o USING (entity_id) WHERE n.entity_name = o.entity_name"),
    (storage_layout, "SELECT CAST(strftime(stock_date, '%Y%m') AS INT) AS stock_month, count(*) AS n_rows, CAST(0 AS BIGINT) AS out_of_order FROM fact_stock_snapshot GROUP BY ALL"),
    (ddl_columns, f"""SELECT table_name AS in_table, column_name AS in_field, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS kind
FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{t}'" for t in MART if t != 'dim_date')}) AND column_name <> 'load_no'"""),
    (runner_counts, with_sources("\nUNION ALL ".join(
        ["SELECT 'dim_date' AS in_table, CAST(4018 AS BIGINT) AS n_rows"]
        + [f"SELECT '{t}', count(*) FROM {source} WHERE deleted_at IS NULL" for t, source in (("dim_material", "master_materials"), ("dim_entity", "entities"), ("dim_activity", "master_activities"), ("dim_entity_tag", "entity_tags"), ("dim_location", "regencies"))]
        + ["SELECT 'bridge_entity_tag', count(*) FROM (SELECT DISTINCT entity_id, entity_tag_id FROM entity_entity_tags)",
           "SELECT 'bridge_entity_activity', count(*) FROM (SELECT DISTINCT entity_id, activity_id, join_date, end_date FROM entity_activity_date WHERE deleted_at IS NULL)",
           "SELECT 'fact_stock_snapshot', count(*) FROM stocks"]), "master_materials", "entities", "master_activities", "entity_tags", "regencies", "entity_entity_tags", "entity_activity_date", "stocks")),
    (expr_run_stamp, with_sources("SELECT id, TIMESTAMP '2024-05-06 07:08:09' AS stamp FROM regencies", "regencies")),
):
    _register(_q.__name__, _q, _sql)


# --- statements and URLs ---------------------------------------------------------------------------

#: The statements and URLs that each database expects.
_STATEMENTS = {
    ("postgres", "insert"): 'INSERT INTO t ("id", "v") VALUES (:id, :v)',
    ("postgres", "upsert"): 'INSERT INTO t ("id", "v") VALUES (:id, :v) ON CONFLICT ("id") DO UPDATE SET "v" = EXCLUDED."v"',
    ("postgres", "keys only"): 'INSERT INTO t ("id", "v") VALUES (:id, :v) ON CONFLICT ("id", "v") DO NOTHING',
    ("postgres", "truncate"): "TRUNCATE TABLE t CASCADE",
    ("postgres", "url"): "jdbc:postgresql://h:1/d",
    ("postgres", "driver url"): "postgresql+psycopg2://u:p%40@h:1/d",
    ("mysql", "insert"): "INSERT INTO t (`id`, `v`) VALUES (:id, :v)",
    ("mysql", "upsert"): "INSERT INTO t (`id`, `v`) VALUES (:id, :v) ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)",
    ("mysql", "keys only"): "INSERT IGNORE INTO t (`id`, `v`) VALUES (:id, :v)",
    ("mysql", "truncate"): "TRUNCATE TABLE t",
    ("mysql", "url"): "jdbc:mysql://h:1/d",
    ("mysql", "driver url"): "mysql+pymysql://u:p%40@h:1/d",
    ("mariadb", "insert"): "INSERT INTO t (`id`, `v`) VALUES (:id, :v)",
    ("mariadb", "upsert"): "INSERT INTO t (`id`, `v`) VALUES (:id, :v) ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)",
    ("mariadb", "keys only"): "INSERT IGNORE INTO t (`id`, `v`) VALUES (:id, :v)",
    ("mariadb", "truncate"): "TRUNCATE TABLE t",
    ("mariadb", "url"): "jdbc:mariadb://h:1/d",
    ("mariadb", "driver url"): "mariadb+pymysql://u:p%40@h:1/d",
    ("mssql", "insert"): 'INSERT INTO t ("id", "v") VALUES (:id, :v)',
    ("mssql", "upsert"): 'MERGE INTO t target USING (SELECT :id AS "id", :v AS "v") source ON target."id" = source."id" WHEN MATCHED THEN UPDATE SET target."v" = source."v" WHEN NOT MATCHED THEN INSERT ("id", "v") VALUES (source."id", source."v");',
    ("mssql", "keys only"): 'MERGE INTO t target USING (SELECT :id AS "id", :v AS "v") source ON target."id" = source."id" AND target."v" = source."v" WHEN NOT MATCHED THEN INSERT ("id", "v") VALUES (source."id", source."v");',
    ("mssql", "truncate"): "TRUNCATE TABLE t",
    ("mssql", "url"): "jdbc:sqlserver://h:1;databaseName=d;encrypt=true;trustServerCertificate=true;",
    ("mssql", "driver url"): "mssql+pyodbc://u:p%40@h:1/d?driver=ODBC+Driver+17+for+SQL+Server&TrustServerCertificate=yes",
    ("oracle", "insert"): 'INSERT INTO t ("id", "v") VALUES (:id, :v)',
    ("oracle", "upsert"): 'MERGE INTO t target USING (SELECT :id AS "id", :v AS "v" FROM DUAL) source ON (target."id" = source."id") WHEN MATCHED THEN UPDATE SET target."v" = source."v" WHEN NOT MATCHED THEN INSERT ("id", "v") VALUES (source."id", source."v")',
    ("oracle", "keys only"): 'MERGE INTO t target USING (SELECT :id AS "id", :v AS "v" FROM DUAL) source ON (target."id" = source."id" AND target."v" = source."v") WHEN NOT MATCHED THEN INSERT ("id", "v") VALUES (source."id", source."v")',
    ("oracle", "truncate"): "TRUNCATE TABLE t CASCADE",
    ("oracle", "url"): "jdbc:oracle:thin:@h:1/d",
    ("oracle", "driver url"): "oracle+cx_oracle://u:p%40@h:1/d",
    ("mysql", "job url"): "jdbc:mysql://h:1/d?useSSL=false&allowPublicKeyRetrieval=true&serverTimezone=UTC",
    ("clickhouse", "job url"): "jdbc:clickhouse://h:1/d",
    ("clickhouse", "truncate"): "TRUNCATE TABLE t",
}


def database_statements(spark: SparkSession, d: str) -> DataFrame:
    """Every statement and URL of the five transactional databases and of the job's, and the database that each URL names."""
    found = []
    for db in ("postgres", "mysql", "mariadb", "mssql", "oracle"):
        url = jdbc.jdbc_url(db, "h", 1, "d")
        texts = {
            "insert": upsert_sql(db, "t", ["id", "v"]), "upsert": upsert_sql(db, "t", ["id", "v"], ["id"]), "keys only": upsert_sql(db, "t", ["id", "v"], ["id", "v"]),
            "truncate": jdbc.truncate_sql(jdbc.Target(url, "t")), "url": url, "driver url": jdbc.sql_url(db, "h", 1, "d", "u", "p@"),
        }
        found += [(jdbc.dialect_of_url(url).name, what, text) for what, text in texts.items()]
    found += [(jdbc.dialect_of_url(url).name, "job url", url) for url in (jdbc.job_url(db, "h", 1, "d") for db in ("mysql", "clickhouse"))]
    found.append(("clickhouse", "truncate", jdbc.truncate_sql(jdbc.Target(jdbc.job_url("clickhouse", "h", 1, "d"), "t"))))
    return spark.createDataFrame(found, "database string, what string, text string")


_quote = lambda x: "'" + x.replace("'", "''") + "'"
_register("database_statements", database_statements, "SELECT * FROM (VALUES " + ", ".join(f"({_quote(db)}, {_quote(what)}, {_quote(text)})" for (db, what), text in _STATEMENTS.items()) + ") x(database, what, text)")


# --- databases -------------------------------------------------------------------------------------
# The embedded database runs in the driver, which alone reads and writes it where tasks run elsewhere.


def _database_url() -> str:
    """A new database in a folder of the driver, whose memory may not hold it; deleted at the end."""
    folder = tempfile.mkdtemp(prefix="lumbung-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"jdbc:derby:{folder}/db;create=true"


def _database(spark: SparkSession, d: str, table: str, *columns: str) -> JdbcSink:
    """A database table with some columns of a mart table."""
    sink = JdbcSink(spark, jdbc.Target(_database_url(), table.upper()), partitions=2)
    sink.replace(Tables(spark, d)[table].select(*columns))
    return sink


def source_jdbc_query(spark: SparkSession, d: str) -> DataFrame:
    sink = _database(spark, d, "dim_material", "material_id", "is_vaccine")
    return jdbc.read_query(spark, sink.target, 'SELECT "is_vaccine", COUNT(*) AS "n_rows" FROM DIM_MATERIAL GROUP BY "is_vaccine"').withColumn("n_rows", F.col("n_rows").cast("long"))


def source_jdbc_split(spark: SparkSession, d: str) -> DataFrame:
    sink = _database(spark, d, "dim_material", "material_id", "category")
    return jdbc.read_query(spark, sink.target, 'SELECT "material_id", "category" FROM DIM_MATERIAL', jdbc.split_of(spark, sink.target, "material_id", 4))


def source_jdbc_keys(spark: SparkSession, d: str) -> DataFrame:
    return jdbc.read_keys(spark, _database(spark, d, "bridge_entity_tag", "entity_id", "tag_id").target, ["entity_id", "tag_id"])


def source_jdbc_columns(spark: SparkSession, d: str) -> DataFrame:
    return jdbc.read_columns(spark, _database(spark, d, "dim_entity_tag", "tag_id", "tag_name").target, ["tag_name"])


def source_jdbc_count(spark: SparkSession, d: str) -> DataFrame:
    n = jdbc.count_rows(spark, _database(spark, d, "dim_activity", "activity_id").target)
    return spark.createDataFrame([(n,)], "n_rows long")


def etl_over_jdbc(spark: SparkSession, d: str) -> DataFrame:
    """The fact built from a database as the job does, its large tables read in ranges of their ids."""
    url, sources = _database_url(), AdaptedTables(spark, d)
    for name in _FACT_SOURCES:
        JdbcSink(spark, jdbc.Target(url, name), partitions=4).replace(sources[name])
    tables = pipeline.jdbc_tables(spark, url, "", "", {"stocks": 4, "batches": 2}, _FACT_SOURCES)
    return builders.fact_stock_snapshot(tables).select("stock_id", "stock_date", "batch_code", "entity_id", "material_id", "province_id", "stock_quantity")


def etl_to_database(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tables that the runner wrote to a database, twice by upsert and once by overwrite."""
    url, tables = _database_url(), AdaptedTables(spark, d)
    jobs = [pipeline.TableJob(name) for name in ("dim_material", "dim_entity")]
    targets = {j.name: jdbc.Target(url, j.name) for j in jobs}
    pipeline.run_to_database(spark, tables, targets, jobs, partitions=2)
    again = [replace(j, method="upsert", keys=tuple(KEYS[j.name])) for j in jobs]
    stats = pipeline.run_to_database(spark, tables, targets, again)
    return spark.createDataFrame([(name, JdbcSink(spark, targets[name]).count(), s.skipped) for name, s in stats.items()], "in_table string, n_rows long, skipped long")


def stream_upsert_result(spark: SparkSession, d: str) -> DataFrame:
    """A table that a stream of facilities keeps current, over one that lacks the last two deliveries."""
    folder = work_folder(spark, "stream")
    sink = ParquetSink(spark, f"{folder}/t")
    sink.replace(_target(spark, d).drop("updated_at"))
    stream = spark.readStream.schema(Tables(spark, d)["dim_entity"].schema).parquet(f"{d}/dim_entity.parque[t]").select(*_WRITE_COLUMNS[:-1])
    query = upsert_stream(stream, sink, ["entity_id"], ["load_no"], f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sink.read()


def sink_jdbc_upsert(spark: SparkSession, d: str) -> DataFrame:
    sink = JdbcSink(spark, jdbc.Target(_database_url(), "T"), partitions=2)
    try:
        sink.replace(_target(spark, d))
        run_method(_source(spark, d), sink, "upsert", ["entity_id"])
        return sink.read()
    finally:
        if jdbc.in_driver(spark, sink.target):  # all is read: the driver need not hold the database any longer
            jdbc.close_database(spark, sink.target)


def _jdbc_written(method: str, empty: bool = False, **options: object) -> Query:
    """A database table after a write over its declared schema."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        sink = JdbcSink(spark, jdbc.Target(_database_url(), "T"), partitions=2)
        sink.replace(_target(spark, d))
        run_method(_source(spark, d).where(F.lit(not empty)), sink, method, ["entity_id"] if method == "upsert" else None, **options)
        return sink.read()

    return query


def _row_wise(what: str) -> Query:
    """A table of the embedded file database after an upsert row by row, or the rows that it refused: those without a province."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        path = hadoop_path(spark, f"{work_folder(spark, 'rows')}/t.db")[1].toUri().getPath()
        connect = lambda: sqlite3.connect(path, timeout=120)
        with connect() as c:
            c.execute('CREATE TABLE t ("entity_id" INTEGER PRIMARY KEY, "entity_name" TEXT, "province_id" TEXT NOT NULL)')
        columns = ("entity_id", "entity_name", "province_id")
        write_rows(_target(spark, d).select(*columns), connect, "sqlite", "t", ["entity_id"], batch_size=500)
        out = write_rows(_source(spark, d).select(*columns), connect, "sqlite", "t", ["entity_id"], batch_size=500)
        if what == "refused":
            return out.failed.drop("_error")
        with connect() as c:
            return spark.createDataFrame(c.execute("SELECT * FROM t").fetchall(), "entity_id int, entity_name string, province_id string")

    return query


_register("sink_jdbc_overwrite", _jdbc_written("overwrite"), f"WITH {_NOW_SQL} SELECT * FROM now_rows")
_register("sink_jdbc_append", _jdbc_written("append"), f"WITH {_NOW_SQL}, {_OLD_SQL} SELECT * FROM now_rows UNION ALL SELECT * FROM old_rows")
_register("sink_jdbc_truncate", _jdbc_written("truncate", empty=True), f"WITH {_OLD_SQL} SELECT * FROM old_rows WHERE 1 = 0")
_register("sink_jdbc_whole", _jdbc_written("upsert", transaction=True), f"WITH {_NOW_SQL} SELECT * FROM now_rows")
_register("sink_rows_upsert", _row_wise("table"), f"WITH {_NOW_SQL} SELECT entity_id, entity_name, province_id FROM now_rows WHERE province_id IS NOT NULL")
_register("sink_rows_refused", _row_wise("refused"), f"WITH {_NOW_SQL} SELECT entity_id, entity_name, province_id FROM now_rows WHERE province_id IS NULL")

for _q, _sql in (
    (source_jdbc_query, "SELECT is_vaccine, count(*) AS n_rows FROM dim_material GROUP BY is_vaccine"),
    (source_jdbc_split, "SELECT material_id, category FROM dim_material"),
    (source_jdbc_keys, "SELECT DISTINCT entity_id, tag_id FROM bridge_entity_tag"),
    (source_jdbc_columns, "SELECT tag_name FROM dim_entity_tag"),
    (source_jdbc_count, "SELECT count(*) AS n_rows FROM dim_activity"),
    (sink_jdbc_upsert, f"WITH {_NOW_SQL} SELECT * FROM now_rows"),
    (etl_over_jdbc, with_sources(f"SELECT s.id AS stock_id, CAST(s.createdAt AS DATE) AS stock_date, b.code AS batch_code, m.entity_id, m.master_material_id AS material_id, e.province_id, coalesce(s.qty, 0) AS stock_quantity {_FACT_FROM}", *_FACT_SOURCES)),
    (etl_to_database, with_sources("SELECT 'dim_material' AS in_table, count(*) AS n_rows, count(*) AS skipped FROM master_materials WHERE deleted_at IS NULL UNION ALL SELECT 'dim_entity', count(*), count(*) FROM entities WHERE deleted_at IS NULL", "master_materials", "entities")),
    (stream_upsert_result, "SELECT entity_id, entity_name, entity_type, province_id, status, load_no FROM dim_entity"),
):
    _register(_q.__name__, _q, _sql)


_CHECKED = [name for name in MART if name != "dim_date"]


def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    return check_mart(Tables(spark, d), _CHECKED)


def _quality_sql() -> str:
    out = []
    for name in _CHECKED:
        keys, filled = KEYS[name], [f.name for f in MART[name] if not f.nullable]
        repeated = f"SELECT 1 FROM {name} WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY {', '.join(keys)} HAVING count(*) > 1"
        out.append(f"SELECT 'unique({', '.join(keys)})' AS \"check\", '{name}' AS \"table\", (SELECT count(*) FROM ({repeated})) AS violations")
        out.append(f"SELECT 'not_null({', '.join(filled)})', '{name}', (SELECT count(*) FROM {name} WHERE {' OR '.join(f'{c} IS NULL' for c in filled)})")
    for name, column, parent in REFERENCES:
        key = KEYS[parent][0]
        out.append(f"SELECT 'references({column})', '{name}', (SELECT count(*) FROM {name} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent}))")
    return "\nUNION ALL ".join(out)


_register("quality_checks", quality_checks, _quality_sql())
