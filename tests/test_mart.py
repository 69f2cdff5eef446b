"""Expressions, builders, dashboards: nulls, defaults and plans."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lumbung import functions as fn
from lumbung.plans import builders, dashboards as dash
from catalogue.reference import built_mart
from lumbung.schemas import MART, cast_to
from catalogue.adapter import AdaptedTables
from lumbung.sources.tables import Tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_expressions_on_null_and_unknown(spark):
    df = spark.createDataFrame([(1, None), (None, "x"), (9, "y")], "a int, b string")
    rows = df.select(fn.entity_type("a"), fn.category("a"), fn.flag("a"), fn.or_unknown("b", "material")).collect()
    assert [tuple(r) for r in rows] == [("Dinas Kesehatan Provinsi", "Vaccine", 1, "Unknown Material"), ("Lainnya", "Non-Vaccine", 0, "x"), ("Lainnya", "Non-Vaccine", 0, "y")]


def test_date_key_and_finite(spark):
    df = spark.createDataFrame([(date(2024, 2, 9), 1.5), (None, float("nan")), (None, float("inf")), (None, None)], "d date, x double")
    assert [tuple(r) for r in df.select(fn.date_key("d"), fn.month_key("d"), fn.is_finite("x")).collect()] == [(20240209, 202402, True), (None, None, False), (None, None, False), (None, None, False)]


def test_exact_sum_ignores_what_is_no_number(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert df.agg(fn.exact_sum("x")).first()[0] == 0.3
    assert df.where("false").agg(fn.exact_sum("x")).first()[0] is None


def test_sums_leave_out_no_finite_value(spark):
    total = lambda *values: spark.createDataFrame([(v,) for v in values], "x double").agg(fn.exact_sum("x")).first()[0]
    assert total(1e30, 0.1, 0.2) == 1e30 and total(1e22) == 1e22 and total(-1e300, 1.0) == -1e300
    assert total(1e-9, 2e-9) == pytest.approx(3e-9) and total(0.1234567891, 1.0) == pytest.approx(1.1234567891, abs=1e-15)
    assert total(float("nan"), None) is None and total() is None


def test_calendar(spark):
    df = builders.dim_date(spark)
    assert df.count() == 4018 and df.schema.fieldNames() == MART["dim_date"].fieldNames()
    assert builders.dim_date(spark, date(2024, 2, 28), date(2024, 3, 1)).count() == 3


def test_cast_to_rejects_missing_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        cast_to(spark.range(1), MART["dim_activity"])


def test_builders_on_empty_sources(spark, sf):
    t = AdaptedTables(spark, sf)
    empty = Tables(spark, None, {n: t[n].where("false") for n in ("provinces", "regencies", "master_materials", "entities", "master_activities", "entity_tags", "entity_entity_tags", "entity_activity_date", "entity_has_master_materials", "batches", "stocks")})
    for name in builders.BUILDERS:
        df = builders.build(name, spark, empty)
        assert df.count() == 0 and df.columns == MART[name].fieldNames()


ALL = dash.Params(date(1990, 1, 1), date(2030, 1, 1))


def test_unfiltered_total_is_the_sum_and_bounds_the_others(spark, sf):
    mart = built_mart(spark, sf)
    total = dash.total_stock(mart, ALL).first()[0]
    assert total == mart["fact_stock_snapshot"].agg(F.sum("stock_quantity")).first()[0]
    assert dash.stock_by_material(mart, ALL).agg(F.sum("total_stock")).first()[0] <= total


def test_dimension_is_joined_only_when_needed(spark, sf):
    mart = Tables(spark, sf)
    assert "Join" not in plan(dash.total_stock(mart, ALL))
    p = dash.Params(ALL.date_from, ALL.date_to, entity_type="Puskesmas", tag_id=5)
    assert plan(dash.total_stock(mart, p)).count("Join LeftSemi") == 2


def test_filters_reach_the_scan(spark, sf):
    text = dash.total_stock(Tables(spark, sf), dash.Params(date(2024, 1, 1), date(2024, 2, 1), activity_id=3))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in text and "GreaterThanOrEqual(stock_date" in text and "EqualTo(activity_id,3)" in text
    assert "price" not in text.split("ReadSchema")[1]


def test_order_and_ties(spark):
    mart = {
        "fact_stock_snapshot": spark.createDataFrame([(date(2024, 1, 1), 1, m, 1, q) for m, q in ((1, 5.0), (2, 5.0), (3, 9.0), (4, None))], "stock_date date, entity_id int, material_id int, activity_id int, stock_quantity double"),
        "dim_material": spark.createDataFrame([(i, "same", "Vaccine", 1) for i in (1, 2, 3, 4)], "material_id int, material_name string, category string, is_vaccine int"),
    }
    assert [r["material_id"] for r in dash.stock_by_material(mart, ALL).collect()] == [3, 1, 2, 4]


def test_filter_regencies_of_no_province(spark, sf):
    assert dash.filter_regencies(Tables(spark, sf), None).count() == 0
