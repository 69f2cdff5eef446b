"""SQL of the source tables over the driver's tables (FIXTURES.md section 3), for the checking side only."""

ADAPTER_SQL: dict[str, str] = {
    "provinces": """
SELECT
  CAST(r_regionkey AS STRING) AS id,
  CASE WHEN r_regionkey = 4 THEN NULL ELSE r_name END AS name,
  CAST(NULL AS TIMESTAMP) AS deleted_at
FROM region WHERE r_regionkey < 5
""",
    "regencies": """
SELECT
  CAST(n_nationkey AS STRING) AS id,
  CASE WHEN n_nationkey % 7 = 6 THEN NULL ELSE n_name END AS name,
  CAST(n_nationkey AS STRING) AS lat,
  CAST(NULL AS STRING) AS lng,
  CASE WHEN n_nationkey % 10 = 9 THEN NULL WHEN n_nationkey = 3 THEN '99' ELSE CAST(n_regionkey AS STRING) END AS province_id,
  CASE WHEN n_nationkey % 12 = 11 THEN TIMESTAMP '2024-01-01 00:00:00' END AS deleted_at
FROM nation
""",
    "master_materials": """
SELECT
  CAST(p_partkey AS INT) AS id,
  p_brand AS code,
  CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_name END AS name,
  CASE WHEN p_size <= 25 THEN 1 ELSE 0 END AS is_vaccine,
  p_type AS unit,
  CAST(NULL AS STRING) AS unit_of_distribution,
  CAST(p_size AS DOUBLE) AS pieces_per_unit,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 2 END AS temperature_sensitive,
  CAST(2.0 AS DOUBLE) AS temperature_min,
  CAST(8.0 AS DOUBLE) AS temperature_max,
  CASE WHEN p_partkey % 5 = 4 THEN 0 ELSE 1 END AS status,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at,
  TIMESTAMP '2024-01-02 00:00:00' AS updated_at,
  CASE WHEN p_partkey % 40 = 39 THEN TIMESTAMP '2024-02-01 00:00:00' END AS deleted_at
FROM part
""",
    "entities": """
SELECT
  CAST(c_custkey AS INT) AS id,
  c_name AS code,
  CASE WHEN c_custkey % 31 = 30 THEN NULL ELSE c_name END AS name,
  CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE CAST(c_custkey % 9 AS INT) END AS type,
  CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS status,
  CASE WHEN c_custkey % 9 = 3 THEN 1 WHEN c_custkey % 9 = 4 THEN 0 END AS is_puskesmas,
  CAST(n_regionkey AS STRING) AS province_id,
  CAST(c_nationkey AS STRING) AS regency_id,
  CAST(NULL AS STRING) AS postal_code,
  CASE WHEN c_custkey % 2 = 0 THEN 'Indonesia' END AS country,
  CAST(NULL AS STRING) AS lat,
  CAST(NULL AS STRING) AS lng,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at,
  TIMESTAMP '2024-01-02 00:00:00' AS updated_at,
  CASE WHEN c_custkey % 50 = 49 THEN TIMESTAMP '2024-02-01 00:00:00' END AS deleted_at
FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
    "master_activities": """
SELECT DISTINCT
  CAST(SUBSTRING(o_orderpriority, 1, 1) AS INT) AS id,
  o_orderpriority AS code,
  SUBSTRING(o_orderpriority, 3) AS name,
  1 AS is_ordered_sales,
  0 AS is_ordered_purchase,
  CAST(NULL AS INT) AS is_patient_id,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at,
  TIMESTAMP '2024-01-02 00:00:00' AS updated_at,
  CASE WHEN o_orderpriority LIKE '5%' THEN TIMESTAMP '2024-02-01 00:00:00' END AS deleted_at
FROM orders
""",
    "entity_tags": """
SELECT DISTINCT
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS id,
  CONCAT('tag-', o_orderstatus) AS title,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at,
  TIMESTAMP '2024-01-02 00:00:00' AS updated_at,
  CAST(NULL AS TIMESTAMP) AS deleted_at
FROM orders
""",
    "entity_entity_tags": """
SELECT
  CAST(o_orderkey AS INT) AS id,
  CAST(o_custkey AS INT) AS entity_id,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS entity_tag_id,
  o_orderdate AS created_at,
  o_orderdate + INTERVAL 1 DAY AS updated_at
FROM orders WHERE o_custkey % 4 <> 0
""",
    "entity_activity_date": """
SELECT
  CAST(o_orderkey AS INT) AS id,
  CAST(o_custkey AS INT) AS entity_id,
  CAST(SUBSTRING(o_orderpriority, 1, 1) AS INT) AS activity_id,
  CAST(DATE_TRUNC('year', o_orderdate) AS DATE) AS join_date,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS end_date,
  o_orderdate AS created_at,
  o_orderdate + INTERVAL 1 DAY AS updated_at,
  CASE WHEN o_orderkey % 20 = 19 THEN o_orderdate END AS deleted_at
FROM orders
""",
    "entity_has_master_materials": """
SELECT DISTINCT
  o_custkey * 1000000 + l_partkey AS id,
  CAST(o_custkey AS INT) AS entity_id,
  CAST(l_partkey AS INT) AS master_material_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
    "batches": """
SELECT
  o_orderkey AS id,
  CONCAT('B', CAST(o_orderkey AS STRING)) AS code,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate + INTERVAL 365 DAY END AS expired_date,
  CASE WHEN o_orderkey % 30 = 29 THEN o_orderdate END AS deleted_at
FROM orders
""",
    "stocks": """
SELECT
  l_orderkey * 100000000000 + l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS id,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE l_orderkey END AS batch_id,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE o_custkey * 1000000 + l_partkey END AS entity_has_material_id,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(SUBSTRING(o_orderpriority, 1, 1) AS INT) END AS activity_id,
  l_quantity AS qty,
  CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS allocated,
  CASE WHEN l_linestatus = 'O' THEN l_quantity END AS in_transit,
  CAST(l_linenumber AS INT) AS open_vial,
  CAST(0 AS DOUBLE) AS extermination_discard_qty,
  CAST(0 AS DOUBLE) AS extermination_received_qty,
  CAST(0 AS DOUBLE) AS extermination_qty,
  CAST(0 AS DOUBLE) AS extermination_shipped_qty,
  CAST(l_suppkey AS INT) AS budget_source,
  CAST(EXTRACT(YEAR FROM l_shipdate) AS INT) AS year,
  l_extendedprice AS price,
  l_extendedprice * l_quantity AS total_price,
  l_shipdate + INTERVAL 13 HOUR AS createdAt,
  l_shipdate + INTERVAL 1 DAY AS updatedAt
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
}


def with_sources(query: str, *names: str) -> str:
    """``query`` with the named source tables as common table expressions."""
    ctes = ",\n".join(f"{n} AS ({ADAPTER_SQL[n]})" for n in names)
    return f"WITH {ctes}\n{query}"
