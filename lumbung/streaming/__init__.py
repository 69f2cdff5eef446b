"""Micro-batch use of the write methods: a stream of records kept up to date in a mart table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from lumbung.operators.methods import run_method
from lumbung.operators.sinks import ParquetSink


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the row that is last by ``order`` (null first), ties broken by the whole row; partially aggregated."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*order, *(c for c in rest if c not in order)))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*(c if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns))


def upsert_stream(stream: DataFrame, sink: ParquetSink, keys: Sequence[str], order: Sequence[str], checkpoint: str) -> DataStreamWriter:
    """Upsert every micro-batch into ``sink``; a batch that is repeated after a failure changes nothing."""

    def batch(df: DataFrame, _: int) -> None:
        run_method(latest_per_key(df, keys, order), sink, "upsert", keys)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
