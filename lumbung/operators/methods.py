"""The four write methods: overwrite, append, truncate and upsert, each with statistics.

``overwrite`` with an empty source leaves the target alone; ``truncate`` empties it all the same.
Targets are Parquet tables and database tables alike.
``upsert`` inserts new keys, updates changed rows, skips equal ones and never deletes. Without keys
it inserts the rows that the target doesn't hold, comparing every column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, functions as F

from lumbung.operators.merge import check_unique, compare, merged, missing_rows
from lumbung.operators.sinks import JdbcSink, ParquetSink

Sink = ParquetSink | JdbcSink


@dataclass(frozen=True)
class WriteStats:
    """Counts of a write; a count that a method doesn't have is None and left out of ``as_dict``."""

    source_count: int = 0
    count_before: int | None = None
    count_after: int | None = None
    processed: int = 0
    inserted: int = 0
    updated: int | None = None
    skipped: int | None = None
    new_rows: int | None = None
    existing_rows: int | None = None
    changed_rows: int | None = None
    success: int | None = None
    failed: int = 0
    truncated: bool | None = None

    def as_dict(self) -> dict[str, int | bool]:
        return {k: v for k, v in asdict(self).items() if v is not None}


def _failures(sink: Sink) -> int:
    """Rows that a database refused; ``sink.failed`` holds them with their errors."""
    return 0 if sink.failed is None else sink.failed.count()


def _count(sink: Sink) -> int:
    return sink.count() if sink.exists() else 0


def overwrite(df: DataFrame, sink: Sink, keys: Sequence[str] | None = None) -> WriteStats:
    before = _count(sink)
    n = sink.replace(df, keep_if_empty=True)
    failed = _failures(sink)
    if not n + failed:
        return WriteStats()
    return WriteStats(source_count=n + failed, count_before=before, count_after=n, processed=n + failed, inserted=n, failed=failed)


def append(df: DataFrame, sink: Sink, keys: Sequence[str] | None = None) -> WriteStats:
    before = _count(sink)
    n = sink.append(df, keys)
    failed = _failures(sink)
    if not n + failed:
        return WriteStats()
    return WriteStats(source_count=n + failed, count_before=before, count_after=_count(sink) if failed else before + n, processed=n + failed, inserted=n, failed=failed)


def truncate(df: DataFrame, sink: Sink, keys: Sequence[str] | None = None) -> WriteStats:
    before = _count(sink)
    n = sink.replace(df)
    failed = _failures(sink)
    return WriteStats(source_count=n + failed, count_before=before, count_after=n, processed=n + failed, inserted=n, failed=failed, truncated=True)


def _counts(rows: DataFrame) -> dict[str, int]:
    return {r["__change"]: r["n"] for r in rows.groupBy("__change").agg(F.count("*").alias("n")).collect()}


def upsert(df: DataFrame, sink: Sink, keys: Sequence[str] | None = None) -> WriteStats:
    """Keys must be unique in source and target; else ValueError and nothing is written."""
    target = sink.read()
    if target is None:
        if keys:
            check_unique(df, keys, "the source")
        n = sink.replace(df)
        more = {"new_rows": n, "existing_rows": 0, "changed_rows": 0} if keys else {}
        return WriteStats(source_count=n, count_before=0, count_after=n, processed=n, inserted=n, updated=0, skipped=0, success=n, **more)
    before = target.count()
    if not keys:
        new = missing_rows(df, target)
        total, inserted = df.count(), new.count()
        if inserted:
            sink.append(new)
        return WriteStats(source_count=total, count_before=before, count_after=before + inserted, processed=inserted, inserted=inserted, updated=0, skipped=total - inserted, success=inserted)
    failed = lost = 0
    if isinstance(sink, ParquetSink):
        found = sink.upsert(df, keys)
    else:
        check_unique(df, keys, "the source")
        check_unique(target, keys, "the target")
        compared = compare(df, target, keys)
        found = _counts(compared.rows)
        if found.get("new") or found.get("changed"):
            changes = compared.of("new", "changed")
            sink.apply(changes, merged(changes, target, keys), keys)
            if failed := _failures(sink):  # which of the refused rows were new is for the keys to say
                lost = compare(sink.failed.drop("_error"), target, keys).rows.where("__change = 'new'").count()
    new, changed, same = (found.get(k, 0) for k in ("new", "changed", "unchanged"))
    return WriteStats(
        source_count=new + changed + same, count_before=before, count_after=sink.count() if failed else before + new, processed=new + changed,
        inserted=new - lost, updated=changed - (failed - lost), skipped=same, new_rows=new, existing_rows=changed + same, changed_rows=changed,
        success=new + changed - failed, failed=failed,
    )


OPTIONS = ("batch_size", "workers", "partitions", "isolation", "transaction")
METHODS: dict[str, Callable[..., WriteStats]] = {f.__name__: f for f in (overwrite, append, truncate, upsert)}


def run_method(df: DataFrame, sink: Sink, method: str, keys: Sequence[str] | None = None, **options: object) -> WriteStats:
    """Write ``df`` by the named method; ValueError for a name that isn't one of the four.

    ``options`` hold for this write: ``batch_size``, ``workers``, ``partitions``, ``isolation`` and
    ``transaction`` (all or nothing) of a database table. A Parquet table is written all or nothing in
    any case and takes the same options without effect; unknown ones raise ValueError.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}; one of {', '.join(METHODS)}")
    if unknown := set(options) - set(OPTIONS):
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}; of {', '.join(OPTIONS)}")
    if isinstance(sink, ParquetSink) or not options:
        return METHODS[method](df, sink, keys)
    before = {k: getattr(sink, k) for k in options}
    try:
        for k, v in options.items():
            setattr(sink, k, v)
        return METHODS[method](df, sink, keys)
    finally:
        for k, v in before.items():
            setattr(sink, k, v)
