"""Queries of the text problems 7 to 9. Where SQL can say what must hold of a result it does; tests check the rest against plain versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumbung.llm import leakage, packing, quality

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    """The container capacities, a handful of rows."""
    return {r["window_name"]: int(r["capacity_tokens"]) for r in _table(spark, d, "context_windows").orderBy("capacity_tokens").collect()}


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_table(spark, d, "documents"), "doc_id", "text", _capacities(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents in pieces, read from the packing for the largest capacity."""
    capacities = _capacities(spark, d)
    largest = max(capacities, key=capacities.__getitem__)
    packed = packing.pack_documents(_table(spark, d, "documents"), "doc_id", "text", capacities)
    return packed.where((F.col("window_name") == largest) & (F.col("n_pieces") > 1)).select("doc_id").distinct()


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d), _capacities(spark, d))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per window what may not happen: documents lost, doubled, with pieces missing or cut though they fit, containers that hold too much, or a piece beside a full one's."""
    capacities = _capacities(spark, d)
    packed = p7_containers(spark, d)
    capacity = F.create_map(*(F.lit(x) for kv in capacities.items() for x in kv))[F.col("window_name")]
    ids = _table(spark, d, "documents").select("doc_id", F.explode(F.array(*map(F.lit, capacities))).alias("window_name"))
    per = packed.groupBy("window_name", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("piece").alias("different"), F.max("n_pieces").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    docs = ids.join(per, ["window_name", "doc_id"], "full").groupBy("window_name").agg(
        F.count_if(F.col("n").isNull()).alias("lost"),
        F.count_if(F.col("n") > F.col("pieces")).alias("doubled"),
        F.count_if((F.col("different") != F.col("pieces")) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)))).alias("badly_cut"),
    )
    per_container = packed.groupBy("window_name", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.max("position").alias("last"))
    full = per_container.groupBy("window_name").agg(F.count_if(F.col("t") > capacity).alias("overfull"), F.count_if(F.col("last") != F.col("n") - 1).alias("badly_ordered"))
    windows = spark.createDataFrame([(w,) for w in capacities], "window_name string")
    return windows.join(docs, "window_name", "left").join(full, "window_name", "left").na.fill(0)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where(F.col("share") >= leakage.LEAK).select("doc_id", F.col("item_id").cast("int").alias("item_id")).distinct()


def p8_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Every aligned pair with its share of held words, leaks and lesser overlaps alike."""
    return _leaks(spark, d)


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_statistics(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "common_words"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).where(F.col("kind") != quality.PROSE).select("doc_id", "kind")


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d)


def p9_lines(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of words and lines that SQL can say too."""
    r = lambda c: F.round(c, 9).alias(c)
    return _quality(spark, d).select("doc_id", "n_words", r("mean_word_length"), r("punctuated_lines"), r("duplicate_lines"), r("common_share"))


# white space as Python's strip knows it, and its word pattern in classes of the other engine
_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_P9_LINES_SQL = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+(?:[''’.,-][\p{{L}}\p{{N}}_]+)*') AS w FROM t),
cut AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda x: regexp_replace(regexp_replace(x, '^{_SPACE}+', ''), '{_SPACE}+$', '')), lambda x: x <> '') AS lines FROM t),
common AS (SELECT list(DISTINCT lower(word)) AS c FROM common_words WHERE word IS NOT NULL)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 9) ELSE 0 END AS mean_word_length,
  CASE WHEN len(lines) > 0 THEN round(len(list_filter(lines, lambda x: right(x, 1) IN ('.', '!', '?', '…', '"', '”', '»', ':', ';', ',', ')'))) / len(lines), 9) ELSE 0 END AS punctuated_lines,
  CASE WHEN len(lines) > 0 THEN round((list_sum(list_transform(lines, lambda x: length(x))) - list_sum(list_transform(list_distinct(lines), lambda x: length(x)))) / list_sum(list_transform(lines, lambda x: length(x))), 9) ELSE 0 END AS duplicate_lines,
  CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains(c, x))) / len(w), 9) ELSE 0 END AS common_share
FROM words JOIN cut USING (doc_id), common"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (p7_found, p7_containers, p7_fill, p7_invariants, p8_found, p8_alignments, p9_found, p9_statistics, p9_lines)}
SQL: dict[str, str] = {
    "p7_invariants": "SELECT window_name, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS doubled, CAST(0 AS BIGINT) AS badly_cut, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS badly_ordered FROM context_windows",
    "p9_lines": _P9_LINES_SQL,
}
