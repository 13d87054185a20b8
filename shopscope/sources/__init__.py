"""Readers and writers (driver Parquet tables, marketplace CSVs, Parquet stage files)."""
