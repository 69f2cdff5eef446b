"""Parquet and in-memory tables by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Tables(Mapping[str, DataFrame]):
    """Tables of a folder, each resolved when first asked for; ``given`` frames take precedence."""

    def __init__(self, spark: SparkSession, folder: str | None = None, given: Mapping[str, DataFrame] | None = None):
        self.spark, self.folder, self._given = spark, folder, dict(given or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._given:
            if self.folder is None:
                raise KeyError(name)
            self._given[name] = read_table(self.spark, self.folder, name)
        return self._given[name]

    def __iter__(self):
        return iter(self._given)

    def __len__(self) -> int:
        return len(self._given)
