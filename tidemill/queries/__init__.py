"""Registered queries, each with its DuckDB oracle."""
