"""Source tables of the stock pipeline derived from the driver's order tables (FIXTURES.md).

The driver's data has no operational stock database, so its eleven source tables are derived here,
with the nulls, deletions and dangling references that the mart builders have to cope with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lumbung.sources.tables import Tables

_DELETED_ON = "2024-02-01 00:00:00"


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _every(column: str, n: int, rest: int) -> Column:
    return F.col(column) % n == rest


def _stamps(deleted: Column | None = None) -> list[Column]:
    out = [_ts("2024-01-01 00:00:00").alias("created_at"), _ts("2024-01-02 00:00:00").alias("updated_at")]
    return out + [(F.when(deleted, _ts(_DELETED_ON)) if deleted is not None else _null("timestamp_ntz")).alias("deleted_at")]


def _days(column: str, n: int) -> Column:
    return F.col(column) + F.make_dt_interval(F.lit(n))


def provinces(t: Tables) -> DataFrame:
    return t["region"].where("r_regionkey < 5").select(
        F.col("r_regionkey").cast("string").alias("id"), F.when(F.col("r_regionkey") != 4, F.col("r_name")).alias("name"), _null("timestamp_ntz").alias("deleted_at")
    )


def regencies(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    return t["nation"].select(
        k.cast("string").alias("id"),
        F.when(~_every("n_nationkey", 7, 6), F.col("n_name")).alias("name"),
        k.cast("string").alias("lat"),
        _null("string").alias("lng"),
        F.when(_every("n_nationkey", 10, 9), _null("string")).when(k == 3, F.lit("99")).otherwise(F.col("n_regionkey").cast("string")).alias("province_id"),
        F.when(_every("n_nationkey", 12, 11), _ts("2024-01-01 00:00:00")).alias("deleted_at"),
    )


def master_materials(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t["part"].select(
        F.col("p_partkey").cast("int").alias("id"),
        F.col("p_brand").alias("code"),
        F.when(~_every("p_partkey", 97, 0), F.col("p_name")).alias("name"),
        F.when(size <= 25, 1).otherwise(0).alias("is_vaccine"),
        F.col("p_type").alias("unit"),
        _null("string").alias("unit_of_distribution"),
        size.cast("double").alias("pieces_per_unit"),
        F.when(size % 3 != 0, size % 2).alias("temperature_sensitive"),
        F.lit(2.0).alias("temperature_min"),
        F.lit(8.0).alias("temperature_max"),
        F.when(_every("p_partkey", 5, 4), 0).otherwise(1).alias("status"),
        *_stamps(_every("p_partkey", 40, 39)),
    )


def entities(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    nations = t["nation"].select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey"))
    return t["customer"].join(nations, "c_nationkey").select(
        k.cast("int").alias("id"),
        F.col("c_name").alias("code"),
        F.when(~_every("c_custkey", 31, 30), F.col("c_name")).alias("name"),
        F.when(~_every("c_custkey", 10, 9), (k % 9).cast("int")).alias("type"),
        F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("status"),
        F.when(k % 9 == 3, 1).when(k % 9 == 4, 0).alias("is_puskesmas"),
        F.col("n_regionkey").cast("string").alias("province_id"),
        F.col("c_nationkey").cast("string").alias("regency_id"),
        _null("string").alias("postal_code"),
        F.when(_every("c_custkey", 2, 0), F.lit("Indonesia")).alias("country"),
        _null("string").alias("lat"),
        _null("string").alias("lng"),
        *_stamps(_every("c_custkey", 50, 49)),
    )


def _activity_id() -> Column:
    return F.substring("o_orderpriority", 1, 1).cast("int")


def _tag_id() -> Column:
    return F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)


def master_activities(t: Tables) -> DataFrame:
    return t["orders"].select("o_orderpriority").distinct().select(
        _activity_id().alias("id"),
        F.col("o_orderpriority").alias("code"),
        F.expr("substring(o_orderpriority, 3)").alias("name"),
        F.lit(1).alias("is_ordered_sales"),
        F.lit(0).alias("is_ordered_purchase"),
        _null("int").alias("is_patient_id"),
        *_stamps(F.col("o_orderpriority").startswith("5")),
    )


def entity_tags(t: Tables) -> DataFrame:
    return t["orders"].select("o_orderstatus").distinct().select(
        _tag_id().alias("id"), F.concat(F.lit("tag-"), "o_orderstatus").alias("title"), *_stamps()
    )


def entity_entity_tags(t: Tables) -> DataFrame:
    return t["orders"].where("o_custkey % 4 <> 0").select(
        F.col("o_orderkey").cast("int").alias("id"),
        F.col("o_custkey").cast("int").alias("entity_id"),
        _tag_id().alias("entity_tag_id"),
        F.col("o_orderdate").alias("created_at"),
        _days("o_orderdate", 1).alias("updated_at"),
    )


def entity_activity_date(t: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    return t["orders"].select(
        F.col("o_orderkey").cast("int").alias("id"),
        F.col("o_custkey").cast("int").alias("entity_id"),
        _activity_id().alias("activity_id"),
        F.trunc(F.to_date(day), "year").alias("join_date"),
        F.when(_every("o_orderkey", 2, 0), F.to_date(day)).alias("end_date"),
        day.alias("created_at"),
        _days("o_orderdate", 1).alias("updated_at"),
        F.when(_every("o_orderkey", 20, 19), day).alias("deleted_at"),
    )


def _link_id() -> Column:
    return F.col("o_custkey") * 1_000_000 + F.col("l_partkey")


def _lines(t: Tables) -> DataFrame:
    return t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))


def entity_has_master_materials(t: Tables) -> DataFrame:
    return _lines(t).select(_link_id().alias("id"), F.col("o_custkey").cast("int").alias("entity_id"), F.col("l_partkey").cast("int").alias("master_material_id")).distinct()


def batches(t: Tables) -> DataFrame:
    return t["orders"].select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("B"), F.col("o_orderkey").cast("string")).alias("code"),
        F.when(~_every("o_orderkey", 4, 3), _days("o_orderdate", 365)).alias("expired_date"),
        F.when(_every("o_orderkey", 30, 29), F.col("o_orderdate")).alias("deleted_at"),
    )


def stocks(t: Tables) -> DataFrame:
    n, zero = F.col("l_linenumber"), F.lit(0.0)
    return _lines(t).select(
        (F.col("l_orderkey") * 100_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 10 + n).alias("id"),
        F.when(n != 6, F.col("l_orderkey")).alias("batch_id"),
        F.when(n != 7, _link_id()).alias("entity_has_material_id"),
        F.when(n != 5, _activity_id()).alias("activity_id"),
        F.col("l_quantity").alias("qty"),
        F.when(F.col("l_returnflag") != "A", n.cast("double")).alias("allocated"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("in_transit"),
        n.cast("int").alias("open_vial"),
        zero.alias("extermination_discard_qty"),
        zero.alias("extermination_received_qty"),
        zero.alias("extermination_qty"),
        zero.alias("extermination_shipped_qty"),
        F.col("l_suppkey").cast("int").alias("budget_source"),
        F.year("l_shipdate").alias("year"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_quantity")).alias("total_price"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.lit(13))).alias("createdAt"),
        _days("l_shipdate", 1).alias("updatedAt"),
    )


ADAPTED: dict[str, Callable[[Tables], DataFrame]] = {
    f.__name__: f
    for f in (provinces, regencies, master_materials, entities, master_activities, entity_tags, entity_entity_tags, entity_activity_date, entity_has_master_materials, batches, stocks)
}


class AdaptedTables(Tables):
    """The eleven source tables over a folder of the driver's tables."""

    def __getitem__(self, name: str) -> DataFrame:
        if name in ADAPTED and name not in self._given:
            self._given[name] = ADAPTED[name](self)
        return super().__getitem__(name)
