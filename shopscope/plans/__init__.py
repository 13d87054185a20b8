"""Registered queries, their DuckDB twins, and end-to-end studies."""
