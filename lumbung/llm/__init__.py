"""Operators on texts. Nothing outside this package imports it."""
