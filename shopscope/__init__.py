"""shopscope — marketplace order analytics expressed as Spark DataFrame, SQL and ML jobs.

Layout:
  sources/    table readers, declared schemas, the stand-in fact table, Parquet stage files
  functions/  column expressions (days between, half-even rounding, score classes, hash buckets)
  operators/  DataFrame -> DataFrame operators (joins, cleaning, profiling, exploration,
              statistics, sampling, clustering, RFM/CLV, models and metrics)
  plans/      the registered queries, their DuckDB twins, and end-to-end studies
"""

__version__ = "0.1.0"
