"""Per-key results when a few keys hold most rows.

Rows are range-partitioned on the composite key (field, key) and a secondary order, by quantiles
that Spark samples from the data. Partitions are about equally large whatever the keys: a heavy key
is cut into as many ranges of its secondary order as it needs, light keys share a partition. Each
partition aggregates its own rows; only keys that lie on a boundary have more than one partial state,
and a second, small aggregation stitches these together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from lumbung import functions as fn


def key_ranges(df: DataFrame, fields: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``in_field, key_id, value, o0, o1…`` per field of ``fields`` in balanced ranges; ``o0…`` are the order columns.

    Keys are integers, or text if any field's are not; a null key is a key like any other.
    """
    kind = "long" if all(isinstance(df.schema[f].dataType, IntegralType) for f in fields) else "string"
    picked = [F.struct(F.lit(f).alias("in_field"), F.col(f"`{f}`").cast(kind).alias("key_id")) for f in fields]
    orders = [f"o{i}" for i in range(len(order))]
    rows = df.select(F.col(f"`{value}`").alias("value"), *(F.col(f"`{c}`").alias(o) for c, o in zip(order, orders)), F.explode(F.array(*picked)).alias("k"))
    return rows.select("k.in_field", "k.key_id", "value", *orders).repartitionByRange("in_field", "key_id", *orders)


def key_totals(df: DataFrame, fields: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """``in_field, key_id, n_rows, n_values, sum_value, first_order, last_order, share`` of every key, null included.

    ``n_values`` counts the finite values and ``sum_value`` is their exact sum (null without any;
    NaN and infinite values add nothing). ``first_order`` and ``last_order`` are the least and the
    greatest value of the first order column. ``share`` is the key's part of all rows of its field,
    as delivered. Repeated rows count each; other columns are ignored, whatever their names. Empty
    input gives no row.
    """
    totals = (
        key_ranges(df, fields, order, value)
        .groupBy("in_field", "key_id")
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if(fn.is_finite("value")).alias("n_values"),
            fn.exact_sum("value").alias("sum_value"),
            F.min("o0").alias("first_order"),
            F.max("o0").alias("last_order"),
        )
    )
    # one row per field, counted from file footers where there is no filter
    sizes = df.agg(F.count("*").alias("n")).select("n", F.explode(F.array(*map(F.lit, fields))).alias("in_field"))
    return totals.join(F.broadcast(sizes), "in_field").withColumn("share", F.col("n_rows") / F.col("n")).drop("n")


def heavy_keys(df: DataFrame, fields: Sequence[str], value: str, order: Sequence[str], share: float) -> DataFrame:
    """The rows of ``key_totals`` of non-null keys that hold more than ``share`` of all rows."""
    return key_totals(df, fields, value, order).where(F.col("key_id").isNotNull() & (F.col("share") > share))
