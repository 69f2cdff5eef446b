"""Operators on DataFrames; each module states its semantics for nulls, ties and empty input."""
