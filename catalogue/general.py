"""Queries of the general data-processing problems 1 to 6, with SQL for checking where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumbung.operators import history, profile, references, skew, snapshot_diff
from lumbung.operators.intervals import periods_and_gaps
from lumbung.schemas import MART
from lumbung.session import work_folder
from lumbung.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

HEAVY_SHARE = 0.05


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# --- 1. intervals ---------------------------------------------------------------------------------


def _periods(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(read_table(spark, d, "bridge_entity_activity").select("entity_id", "join_date", "end_date"), "entity_id", "join_date", "end_date")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _periods(spark, d).where("kind = 'gap' OR many")
    return rows.select("entity_id", "kind", _day("start_day").alias("start_day"), F.coalesce(_day("end_day"), F.lit("open")).alias("end_day"))


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    """Every period and gap, single intervals included, and the number of days of each that ends."""
    return _periods(spark, d).select("entity_id", "kind", "start_day", "end_day", (F.datediff("end_day", "start_day") + 1).alias("n_days"))


_PERIODS_SQL = """
pairs AS (SELECT DISTINCT entity_id, join_date, end_date FROM bridge_entity_activity
          WHERE entity_id IS NOT NULL AND join_date IS NOT NULL AND (end_date IS NULL OR end_date >= join_date)),
filled AS (SELECT *, COALESCE(datediff('day', DATE '1970-01-01', end_date), 2147483647) AS e, datediff('day', DATE '1970-01-01', join_date) AS b FROM pairs),
reached AS (SELECT *, MAX(e) OVER (PARTITION BY entity_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM filled),
numbered AS (SELECT *, SUM(CASE WHEN r IS NULL OR b > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS g FROM reached),
days AS (SELECT entity_id, MIN(b) AS b, MAX(e) AS e, COUNT(*) AS n FROM numbered GROUP BY entity_id, g),
nexts AS (SELECT *, LEAD(b) OVER (PARTITION BY entity_id ORDER BY b) AS next_b FROM days),
both_kinds AS (SELECT entity_id, 'period' AS kind, n, DATE '1970-01-01' + CAST(b AS INT) AS start_day, CASE WHEN e < 2147483647 THEN DATE '1970-01-01' + CAST(e AS INT) END AS end_day FROM days
  UNION ALL SELECT entity_id, 'gap', 2, DATE '1970-01-01' + CAST(e + 1 AS INT), DATE '1970-01-01' + CAST(next_b - 1 AS INT) FROM nexts WHERE next_b IS NOT NULL)
"""

P1_FOUND_SQL = f"""WITH {_PERIODS_SQL}
SELECT entity_id, kind, strftime(start_day, '%Y-%m-%d') AS start_day, COALESCE(strftime(end_day, '%Y-%m-%d'), 'open') AS end_day FROM both_kinds WHERE n > 1"""

P1_PERIODS_SQL = f"""WITH {_PERIODS_SQL}
SELECT entity_id, kind, start_day, end_day, CAST(end_day - start_day + 1 AS INT) AS n_days FROM both_kinds"""


# --- 2. heavy keys --------------------------------------------------------------------------------

_STOCK_KEYS = ["entity_id", "material_id"]
_STOCK_ORDER = ["source_updated_at", "stock_id"]


def _stock(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "fact_stock_snapshot")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    heavy = skew.heavy_keys(_stock(spark, d), _STOCK_KEYS, "stock_quantity", _STOCK_ORDER, HEAVY_SHARE)
    return heavy.select("in_field", F.col("key_id").cast("int").alias("key_id"))


def p2_key_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = skew.key_totals(_stock(spark, d), _STOCK_KEYS, "stock_quantity", _STOCK_ORDER)
    return totals.select(
        "in_field", "key_id", "n_rows", "n_values", F.round("sum_value", 3).alias("sum_quantity"), F.col("first_order").alias("first_update"), F.col("last_order").alias("last_update"), F.round("share", 9).alias("share")
    )


_KEYED_SQL = """keyed AS (SELECT 'entity_id' AS in_field, entity_id AS key_id, stock_quantity AS q, source_updated_at AS u FROM fact_stock_snapshot
UNION ALL SELECT 'material_id', material_id, stock_quantity, source_updated_at FROM fact_stock_snapshot)"""

P2_FOUND_SQL = f"""WITH {_KEYED_SQL} SELECT in_field, key_id FROM keyed WHERE key_id IS NOT NULL GROUP BY in_field, key_id
HAVING COUNT(*) > {HEAVY_SHARE} * (SELECT COUNT(*) FROM fact_stock_snapshot)"""

P2_KEY_TOTALS_SQL = f"""WITH {_KEYED_SQL}
SELECT in_field, CAST(key_id AS BIGINT) AS key_id, COUNT(*) AS n_rows, COUNT(*) FILTER (isfinite(q)) AS n_values,
  ROUND(CASE WHEN COUNT(*) FILTER (isfinite(q)) > 0 THEN COALESCE(CAST(SUM(CASE WHEN isfinite(q) AND abs(q) < 1e22 THEN CAST(q AS DECIMAL(28, 6)) END) AS DOUBLE), 0)
    + COALESCE(SUM(CASE WHEN isfinite(q) AND abs(q) >= 1e22 THEN q END), 0) END, 3) AS sum_quantity,
  MIN(u) AS first_update, MAX(u) AS last_update, ROUND(COUNT(*) * 1.0::DOUBLE / (SELECT COUNT(*) FROM fact_stock_snapshot), 9) AS share
FROM keyed GROUP BY in_field, key_id"""


# --- 3. orphan references -------------------------------------------------------------------------


def _references(spark: SparkSession, d: str) -> list[references.Reference]:
    deleted = read_table(spark, d, "deleted_keys")

    def of(dim: str) -> DataFrame:
        return deleted.where(F.col("dim_name") == dim).select("key_id")

    fact, tags = _stock(spark, d), read_table(spark, d, "bridge_entity_tag")
    out = []
    for f, dim in (("entity_id", "dim_entity"), ("material_id", "dim_material"), ("activity_id", "dim_activity")):
        out.append(references.Reference("fact_stock_snapshot", f, fact, F.col("stock_id").cast("string"), "source_created_at", "stock_date", read_table(spark, d, dim), f, "created_at", of(dim)))
    pair = F.concat_ws(":", F.col("entity_id").cast("string"), F.col("tag_id").cast("string"))
    out.append(references.Reference("bridge_entity_tag", "tag_id", tags, pair, "created_at", "created_at", read_table(spark, d, "dim_entity_tag"), "tag_id", "created_at", of("dim_entity_tag")))
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(_references(spark, d)).select("in_table", "in_field", "record_key", "ref_month", "kind").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(references.orphan_references(_references(spark, d)))


def _one_reference_sql(table: str, f: str, dim: str, record: str, created: str, month: str) -> str:
    return f"""SELECT DISTINCT '{table}' AS in_table, '{f}' AS in_field, {record} AS record_key, strftime(t.{month}, '%Y-%m') AS ref_month, t.{f} AS key_id,
CASE WHEN p.{f} IS NOT NULL THEN 'late' WHEN EXISTS (SELECT 1 FROM deleted_keys k WHERE k.dim_name = '{dim}' AND k.key_id = t.{f}) THEN 'deleted' ELSE 'missing' END AS kind
FROM {table} t LEFT JOIN {dim} p ON t.{f} = p.{f} WHERE t.{f} IS NOT NULL AND (p.{f} IS NULL OR p.created_at > t.{created})"""


_ORPHANS_SQL = "orphans AS (" + "\nUNION ALL ".join(
    [_one_reference_sql("fact_stock_snapshot", f, dim, "CAST(t.stock_id AS VARCHAR)", "source_created_at", "stock_date") for f, dim in (("entity_id", "dim_entity"), ("material_id", "dim_material"), ("activity_id", "dim_activity"))]
    + [_one_reference_sql("bridge_entity_tag", "tag_id", "dim_entity_tag", "CAST(t.entity_id AS VARCHAR) || ':' || CAST(t.tag_id AS VARCHAR)", "created_at", "created_at")]
) + ")"

P3_FOUND_SQL = f"WITH {_ORPHANS_SQL} SELECT DISTINCT in_table, in_field, record_key, ref_month, kind FROM orphans"
P3_REPORT_SQL = f"WITH {_ORPHANS_SQL} SELECT in_table, in_field, ref_month, kind, COUNT(*) AS n_references, COUNT(DISTINCT key_id) AS n_keys FROM orphans GROUP BY ALL"


# --- 4. profile -----------------------------------------------------------------------------------


def _profiled(spark: SparkSession, d: str) -> list[profile.Profiled]:
    of = profile.Profiled.every_column
    return [
        of("fact_stock_snapshot", _stock(spark, d), "stock_id", "load_no", {"stock_quantity": profile.in_range("stock_quantity", 0, 1_000_000)}),
        of("dim_entity", read_table(spark, d, "dim_entity"), "entity_id", "load_no", {"province_id": profile.matches("province_id", "[0-9]{2}")}),
        of("dim_material", read_table(spark, d, "dim_material"), "material_id", "load_no", {"pieces_per_unit": profile.whole_number("pieces_per_unit", 1, 10_000)}),
    ]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    tables = _profiled(spark, d)
    found = profile.shifted_loads(tables).select("in_table", "in_field", F.lit("load").alias("kind"), F.col("load_no").cast("string").alias("case_key"))
    for p in tables:
        found = found.unionByName(profile.broken_values(p).select("in_table", "in_field", F.lit("value").alias("kind"), "case_key"))
    return found


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the three tables per load."""
    a, b, c = map(profile.column_profile, _profiled(spark, d))
    return a.unionByName(b).unionByName(c)


def p4_load_statistics(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = map(profile.load_statistics, _profiled(spark, d))
    return a.unionByName(b).unionByName(c)


def p4_discrimination(spark: SparkSession, d: str) -> DataFrame:
    return profile.load_discrimination(_profiled(spark, d))


_VALID = {
    "stock_quantity": ("fact_stock_snapshot", "stock_id", "isfinite(stock_quantity) AND stock_quantity BETWEEN 0 AND 1000000"),
    "province_id": ("dim_entity", "entity_id", "regexp_full_match(province_id, '[0-9]{2}')"),
    "pieces_per_unit": ("dim_material", "material_id", "isfinite(pieces_per_unit) AND pieces_per_unit BETWEEN 1 AND 10000 AND floor(pieces_per_unit) = pieces_per_unit"),
}


def _statistics_sql(c: str) -> str:
    table, _, valid = _VALID[c]
    if c == "province_id":
        more = f"CAST(NULL AS DOUBLE) AS median, (SELECT MAX(k) FROM (SELECT COUNT(*) AS k FROM {table} x WHERE x.load_no = t.load_no AND x.{c} IS NOT NULL GROUP BY x.{c})) AS top_count"
    else:
        more = f"MEDIAN(CASE WHEN {valid} THEN {c} END) AS median, CAST(NULL AS BIGINT) AS top_count"
    return f"SELECT '{table}' AS in_table, '{c}' AS in_field, load_no, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_null, COUNT(DISTINCT {c}) AS n_distinct, {more} FROM {table} t GROUP BY load_no"


P4_LOAD_STATISTICS_SQL = "\nUNION ALL ".join(map(_statistics_sql, _VALID))

def _range_sql(table: str, c: str, kind: str) -> str:
    size = {
        "double": f"CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END", "string": f"length({c})::DOUBLE", "date": f"date_diff('day', DATE '1970-01-01', {c})::DOUBLE", "timestamp_ntz": f"epoch({c})::DOUBLE",
    }.get(kind, f"{c}::DOUBLE")
    rule = _VALID.get(c)
    valid = rule[2] if rule and rule[0] == table else f"isfinite({c}::DOUBLE)" if kind == "double" else "true"
    return f"SELECT '{table}' AS in_table, '{c}' AS in_field, load_no, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_null, COUNT(*) FILTER ({c} IS NOT NULL AND NOT ({valid})) AS n_broken, COUNT(DISTINCT {c}) AS n_distinct, MIN({size}) AS low, MAX({size}) AS high FROM {table} GROUP BY load_no"


P4_PROFILE_SQL = "\nUNION ALL ".join(_range_sql(t, f.name, f.dataType.simpleString()) for t in ("fact_stock_snapshot", "dim_entity", "dim_material") for f in MART[t])

P4_FOUND_SQL = f"""WITH stats AS ({P4_LOAD_STATISTICS_SQL}),
pairs AS (SELECT *, n_null / n_rows AS ns, COALESCE(top_count, 0) / n_rows AS ts, LAG(n_null / n_rows) OVER w AS ons, LAG(COALESCE(top_count, 0) / n_rows) OVER w AS ots, LAG(median) OVER w AS om, LAG(load_no) OVER w AS ol
  FROM stats WINDOW w AS (PARTITION BY in_table, in_field ORDER BY load_no))
SELECT in_table, in_field, 'load' AS kind, CAST(load_no AS VARCHAR) AS case_key FROM pairs
WHERE ol IS NOT NULL AND (abs(ns - ons) > 0.10 OR (in_field = 'province_id' AND abs(ts - ots) > 0.20) OR (median <> om AND (median >= 2 * om OR median <= om / 2)))
""" + "".join(f"UNION ALL SELECT DISTINCT '{t}', '{c}', 'value', CAST({k} AS VARCHAR) FROM {t} WHERE {c} IS NOT NULL AND NOT ({valid})\n" for c, (t, k, valid) in _VALID.items())


# --- 5. history -----------------------------------------------------------------------------------

_ATTRIBUTES = ("entity_type", "status", "regency_id")


def _history(spark: SparkSession, d: str) -> history.History:
    return history.store(read_table(spark, d, "entity_snapshots"), "entity_id", _ATTRIBUTES, "snapshot_date", "received_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = history.reconstruct(_history(spark, d)).where("n_versions > 1")
    return rows.select("entity_id", _day("valid_from").alias("valid_from"), F.coalesce(_day("valid_to"), F.lit("open")).alias("valid_to"))


def p5_versions(spark: SparkSession, d: str) -> DataFrame:
    return history.reconstruct(_history(spark, d)).drop("n_versions")


def _grown(spark: SparkSession, d: str) -> history.History:
    """The history as it is kept: saved after the first half of the time of receipt, and extended by the rest."""
    rows, folder = read_table(spark, d, "entity_snapshots"), work_folder(spark, "history")
    low, high = rows.agg(F.min("received_at"), F.max("received_at")).first()
    middle = F.lit(None if low is None else low + (high - low) / 2).cast("timestamp_ntz")
    late = F.coalesce(F.col("received_at") > middle, F.lit(False))
    h = history.save(history.store(rows.where(~late), "entity_id", _ATTRIBUTES, "snapshot_date", "received_at"), f"{folder}/first")
    return history.save(history.extend(h, rows.where(late), "snapshot_date", "received_at"), f"{folder}/whole")


def p5_extended(spark: SparkSession, d: str) -> DataFrame:
    return history.reconstruct(_grown(spark, d)).drop("n_versions")


_AS_OF = date(2024, 3, 15)


def p5_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The attributes of every facility on a day, from the nearest checkpoints of the kept history."""
    return history.as_of(_grown(spark, d), _AS_OF, ends=False)


_VERSIONS_SQL = """
held AS (SELECT entity_id, snapshot_date AS day, entity_type, status, regency_id FROM entity_snapshots WHERE entity_id IS NOT NULL AND snapshot_date IS NOT NULL
  QUALIFY ROW_NUMBER() OVER (PARTITION BY entity_id, snapshot_date ORDER BY received_at DESC NULLS LAST, entity_type DESC NULLS LAST, status DESC NULLS LAST, regency_id DESC NULLS LAST) = 1),
marked AS (SELECT *, ROW_NUMBER() OVER w = 1 OR entity_type IS DISTINCT FROM LAG(entity_type) OVER w OR status IS DISTINCT FROM LAG(status) OVER w OR regency_id IS DISTINCT FROM LAG(regency_id) OVER w AS begins
  FROM held WINDOW w AS (PARTITION BY entity_id ORDER BY day)),
versions AS (SELECT *, LEAD(day) OVER w AS next_day, CAST(ROW_NUMBER() OVER w AS INT) AS version, COUNT(*) OVER (PARTITION BY entity_id) AS n FROM marked WHERE begins WINDOW w AS (PARTITION BY entity_id ORDER BY day))
"""
P5_FOUND_SQL = f"""WITH {_VERSIONS_SQL} SELECT entity_id, strftime(day, '%Y-%m-%d') AS valid_from,
COALESCE(strftime(CAST(next_day - INTERVAL 1 DAY AS DATE), '%Y-%m-%d'), 'open') AS valid_to FROM versions WHERE n > 1"""
P5_AS_OF_SQL = f"""WITH {_VERSIONS_SQL} SELECT entity_id, day AS valid_from, entity_type, status, regency_id FROM versions WHERE day <= DATE '{_AS_OF}' AND (next_day IS NULL OR next_day > DATE '{_AS_OF}')"""
P5_VERSIONS_SQL = f"""WITH {_VERSIONS_SQL} SELECT entity_id, day AS valid_from, CAST(next_day - INTERVAL 1 DAY AS DATE) AS valid_to, version, entity_type, status, regency_id FROM versions"""


# --- 6. snapshot changes --------------------------------------------------------------------------


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshot_diff.snapshot_changes(read_table(spark, d, "stock_snapshots"), "stock_id", "snapshot_date", "source_updated_at", ["stock_quantity", "allocated"])
    return rows.select(_day("snapshot_date").alias("snapshot_day"), "stock_id", "how_changed")


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """The same from tables that are kept per delivery: each is made when its delivery comes and read with the next."""
    rows, folder = read_table(spark, d, "stock_snapshots"), work_folder(spark, "tables")
    columns = ("stock_id", "source_updated_at", ["stock_quantity", "allocated"])
    days = [r[0] for r in rows.select("snapshot_date").where("snapshot_date IS NOT NULL").distinct().orderBy("snapshot_date").collect()]
    buckets = snapshot_diff.bucket_count(rows.count(), len(days))
    of = [rows.where(F.col("snapshot_date") == day) for day in days]
    found = spark.createDataFrame([], "snapshot_day string, stock_id long, how_changed string")
    for i, day in enumerate(days):
        snapshot_diff.delivery_tables(of[i], *columns, buckets).write.parquet(f"{folder}/{i}")
        if i:
            old, new = (spark.read.parquet(f"{folder}/{k}") for k in (i - 1, i))
            changes = snapshot_diff.changes_between(old, new, of[i - 1], of[i], *columns, buckets)
            found = found.unionByName(changes.select(F.lit(str(day)).alias("snapshot_day"), "stock_id", "how_changed"))
    return found


P6_FOUND_SQL = """WITH held AS (SELECT snapshot_date AS day, stock_id, stock_quantity AS q, allocated AS a FROM stock_snapshots WHERE stock_id IS NOT NULL AND snapshot_date IS NOT NULL
  QUALIFY ROW_NUMBER() OVER (PARTITION BY snapshot_date, stock_id ORDER BY source_updated_at DESC NULLS LAST, stock_quantity DESC NULLS LAST, allocated DESC NULLS LAST) = 1),
days AS (SELECT day, LAG(day) OVER (ORDER BY day) AS before FROM (SELECT DISTINCT day FROM held)),
new_side AS (SELECT d.day, h.stock_id, h.q, h.a FROM days d JOIN held h ON h.day = d.day WHERE d.before IS NOT NULL),
old_side AS (SELECT d.day, h.stock_id, h.q, h.a FROM days d JOIN held h ON h.day = d.before)
SELECT strftime(COALESCE(n.day, o.day), '%Y-%m-%d') AS snapshot_day, COALESCE(n.stock_id, o.stock_id) AS stock_id,
CASE WHEN o.stock_id IS NULL THEN 'added' WHEN n.stock_id IS NULL THEN 'removed' ELSE 'changed' END AS how_changed
FROM new_side n FULL JOIN old_side o ON n.day = o.day AND n.stock_id = o.stock_id
WHERE n.stock_id IS NULL OR o.stock_id IS NULL OR n.q IS DISTINCT FROM o.q OR n.a IS DISTINCT FROM o.a"""


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_periods, p2_found, p2_key_totals, p3_found, p3_report, p4_found, p4_profile, p4_load_statistics, p4_discrimination, p5_found, p5_versions, p5_extended, p5_as_of, p6_found, p6_kept)
}
SQL: dict[str, str] = {
    "p1_found": P1_FOUND_SQL,
    "p1_periods": P1_PERIODS_SQL,
    "p2_found": P2_FOUND_SQL,
    "p2_key_totals": P2_KEY_TOTALS_SQL,
    "p3_found": P3_FOUND_SQL,
    "p3_report": P3_REPORT_SQL,
    "p4_found": P4_FOUND_SQL,
    "p4_profile": P4_PROFILE_SQL,
    "p4_load_statistics": P4_LOAD_STATISTICS_SQL,
    "p5_found": P5_FOUND_SQL,
    "p5_versions": P5_VERSIONS_SQL,
    "p5_extended": P5_VERSIONS_SQL,
    "p5_as_of": P5_AS_OF_SQL,
    "p6_found": P6_FOUND_SQL,
    "p6_kept": P6_FOUND_SQL,
}
