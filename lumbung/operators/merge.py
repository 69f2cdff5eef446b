"""Comparison of a source with a target by key, and the merged table.

Values are compared as null-safe structs, so null differs from any text and no two different rows
look alike. Keys compare with ``=``: a null key matches nothing and counts as new, unless
``null_safe_keys`` is set. Keys must be unique on both sides; ``check_unique`` finds those that
aren't before a join can multiply rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Columns that differ on every run and say nothing about the record.
UNCOMPARED = ("created_at", "updated_at")


def _q(name: str) -> str:
    return f"`{name}`"


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-null keys that occur more than once, with ``n_rows``."""
    rows = df
    for k in keys:
        rows = rows.where(F.col(_q(k)).isNotNull())
    return rows.groupBy(*map(_q, keys)).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def check_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    found = duplicate_keys(df, keys).limit(3).collect()
    if found:
        raise ValueError(f"{what} holds keys more than once, for example {[tuple(r[k] for k in keys) for r in found]}")


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of the row as JSON with its nulls; for storage, where a struct can't be kept."""
    return F.sha2(F.to_json(F.struct(*(F.col(_q(c)) for c in columns)), {"ignoreNullFields": "false"}), 256)


def row_hashes(columns: Sequence[Column]) -> list[Column]:
    """128 bits of a row: equal rows have equal ones, and which values are null is a part of them."""
    nulls = [c.isNull() for c in columns]
    return [F.xxhash64(F.lit(salt), *columns, *nulls) for salt in (1, 2)]


@dataclass(frozen=True)
class Compared:
    """``rows`` are the source rows with ``change``: ``new``, ``changed`` or ``unchanged``."""

    rows: DataFrame
    columns: list[str]

    def of(self, *changes: str) -> DataFrame:
        return self.rows.where(F.col("__change").isin(*changes)).select(*map(_q, self.columns))


def _on(keys: Sequence[str], null_safe: bool) -> Column:
    on = F.lit(True)
    for k in keys:
        s, t = F.col(f"s.{_q(k)}"), F.col(f"t.{_q(k)}")
        on = on & (s.eqNullSafe(t) if null_safe else s == t)
    return on


def compare(source: DataFrame, target: DataFrame, keys: Sequence[str], ignore: Sequence[str] = UNCOMPARED, null_safe_keys: bool = False) -> Compared:
    """Each source row as new, changed or unchanged against the target, in one left join.

    Columns that only one side has are not compared. The target contributes its keys and compared
    columns only.
    """
    columns = list(source.columns)
    compared = [c for c in columns if c not in keys and c not in ignore and c in target.columns]
    s = source.alias("s")
    t = target.select(*map(_q, [*keys, *compared])).withColumn("__there", F.lit(True)).alias("t")
    pack = lambda side: F.struct(*(F.col(f"{side}.{_q(c)}") for c in compared)) if compared else F.lit(0)
    change = F.when(F.col("t.__there").isNull(), "new").when(~pack("s").eqNullSafe(pack("t")), "changed").otherwise("unchanged")
    joined = s.join(t, _on(keys, null_safe_keys), "left").select(*(F.col(f"s.{_q(c)}") for c in columns), change.alias("__change"))
    return Compared(joined, columns)


def missing_rows(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source rows that no target row equals in every column; nulls equal each other, duplicates stay."""
    columns = list(source.columns)
    t = target.select(*map(_q, columns)).distinct().alias("t")
    return source.alias("s").join(t, _on(columns, True), "left_anti")


def merged(source: DataFrame, target: DataFrame, keys: Sequence[str], null_safe_keys: bool = False) -> DataFrame:
    """The target after an upsert: source rows win, rows only in the target stay.

    Columns that the source lacks keep their old values; columns that the target lacks are not added.
    """
    s = source.withColumn("__s", F.lit(True)).alias("s")
    t = target.withColumn("__t", F.lit(True)).alias("t")
    pick = lambda c: F.when(F.col("s.__s"), F.col(f"s.{_q(c)}")).otherwise(F.col(f"t.{_q(c)}")) if c in source.columns else F.col(f"t.{_q(c)}")
    return s.join(t, _on(keys, null_safe_keys), "full_outer").select(*(pick(c).alias(c) for c in target.columns))


def merged_changes(source: DataFrame, target: DataFrame, keys: Sequence[str], ignore: Sequence[str] = UNCOMPARED, null_safe_keys: bool = False) -> DataFrame:
    """The target after an upsert with ``__change`` of every row, from one full outer join.

    ``new`` and ``changed`` rows are the source's, ``unchanged`` (in every compared column) and
    ``kept`` (of no source row) the target's.
    """
    both = [c for c in target.columns if c in source.columns]
    compared = [c for c in both if c not in keys and c not in ignore]
    s = source.select(*map(_q, both)).withColumn("__s", F.lit(True)).alias("s")
    t = target.withColumn("__t", F.lit(True)).alias("t")
    pack = lambda side: F.struct(*(F.col(f"{side}.{_q(c)}") for c in compared)) if compared else F.lit(0)
    change = F.when(F.col("s.__s").isNull(), "kept").when(F.col("t.__t").isNull(), "new").when(~pack("s").eqNullSafe(pack("t")), "changed").otherwise("unchanged")
    rows = s.join(t, _on(keys, null_safe_keys), "full_outer").withColumn("__change", change)
    won = F.col("__change").isin("new", "changed")
    pick = lambda c: F.when(won, F.col(f"s.{_q(c)}")).otherwise(F.col(f"t.{_q(c)}")) if c in both else F.col(f"t.{_q(c)}")
    return rows.select(*(pick(c).alias(c) for c in target.columns), "__change")
