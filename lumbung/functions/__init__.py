"""Column expressions of the mart, all of them built-in functions that stay in generated code."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

# Labels of facility types and default names, which results must match.
ENTITY_TYPES = {
    1: "Dinas Kesehatan Provinsi",
    2: "Dinas Kesehatan Kabupaten/Kota",
    3: "Puskesmas",
    4: "Rumah Sakit",
    5: "Klinik",
    6: "Apotek",
    7: "Laboratorium",
}
OTHER_ENTITY_TYPE = "Lainnya"
DEFAULT_COUNTRY = "Indonesia"
UNKNOWN = {"province": "Unknown Province", "regency": "Unknown Regency", "material": "Unknown Material", "entity": "Unknown Facility", "activity": "Unknown Activity"}


def or_default(column: Column | str, default: object) -> Column:
    """``column``, or ``default`` where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(default))


def or_unknown(column: Column | str, what: str) -> Column:
    return or_default(column, UNKNOWN[what])


def flag(column: Column | str) -> Column:
    """1 where the value is 1, else 0; null gives 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c == 1, 1).otherwise(0)


def category(is_vaccine: Column | str) -> Column:
    c = F.col(is_vaccine) if isinstance(is_vaccine, str) else is_vaccine
    return F.when(c == 1, "Vaccine").otherwise("Non-Vaccine")


def entity_type(code: Column | str) -> Column:
    """The label of a facility type; unknown codes and null give the catch-all label."""
    c = F.col(code) if isinstance(code, str) else code
    labels = None
    for k, label in ENTITY_TYPES.items():
        labels = F.when(c == k, label) if labels is None else labels.when(c == k, label)
    return labels.otherwise(OTHER_ENTITY_TYPE)


def full_location(province: Column, regency: Column) -> Column:
    return F.concat(province, F.lit(" - "), regency)


def date_key(column: Column | str) -> Column:
    """yyyymmdd as int; null stays null."""
    c = F.to_date(column)
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def month_key(column: Column | str) -> Column:
    """yyyymm as int, the partition value of the fact."""
    c = F.to_date(column)
    return F.year(c) * 100 + F.month(c)


def run_stamp(run_ts: datetime | None) -> Column:
    """The time of the run; injected, so that a rerun gives the same rows."""
    return F.lit(run_ts).cast("timestamp_ntz") if run_ts else F.current_timestamp().cast("timestamp_ntz")


def is_finite(column: Column | str) -> Column:
    """False for null, NaN and the infinities."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def exact_part(column: Column | str) -> Column:
    """The finite value with six decimals; null for others and for values beyond the decimal's range."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(is_finite(c) & (F.abs(c) < 1e22), c).cast("decimal(28,6)")


def rest_part(column: Column | str) -> Column:
    """What ``exact_part`` leaves of a finite value: nothing of most, digits beyond six decimals, or all of 1e22 and more."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(is_finite(c), c - F.coalesce(exact_part(c).cast("double"), F.lit(0.0)))


def sum_of_parts(exact: Column, rest: Column) -> Column:
    """The sum from sums of both parts; null if there was no value."""
    return F.when(rest.isNotNull(), F.coalesce(exact.cast("double"), F.lit(0.0)) + rest)


def exact_sum(column: Column | str) -> Column:
    """Sum of the finite values, the same in whatever order they arrive.

    Six decimals are summed exactly; what lies beyond, and values of 1e22 or more, are added as
    doubles, whose last bit may depend on the order. Null, NaN and infinite values add nothing; no
    value at all gives null.
    """
    return sum_of_parts(F.sum(exact_part(column)), F.sum(rest_part(column)))


def text_digest(columns: list[str]) -> Column:
    """MD5 of the values as text, joined by ``||``, null as the word NULL.

    For comparison with digests that other tools stored. Rows may look alike to it (null and the word
    NULL, values that hold the separator); ``operators.merge`` compares without it.
    """
    return F.md5(F.concat_ws("||", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")) for c in columns)))
