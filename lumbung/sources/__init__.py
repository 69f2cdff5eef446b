"""Readers: Parquet tables and JDBC databases."""

from lumbung.sources.tables import Tables, read_table

__all__ = ["Tables", "read_table"]
