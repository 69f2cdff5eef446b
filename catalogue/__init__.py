"""Queries over the test tables, the SQL that checks them, and the operational tables that are made of them."""
