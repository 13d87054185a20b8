"""Tables stored in buckets of a key, so that joins on it need no shuffle.

Each bucket is one file, sorted by the key: rows are dealt by the hash that Spark's bucketing uses, and each
writing task holds one bucket. Tables of the same key and number of buckets join bucket by bucket. A key
with very many rows makes a large bucket; store by keys that have few rows each (an order has few lines).

The files belong to the folder, not to a session's catalog: ``open_bucketed`` declares them where they
lie, and nothing stays behind in the catalog.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _named(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``df`` to the new folder ``path`` in ``buckets`` buckets of ``key`` (null keys share one)."""
    table = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, _named(key)).write.format("parquet").bucketBy(buckets, key).sortBy(key) \
        .option("path", path).saveAsTable(table)
    df.sparkSession.sql(f"DROP TABLE {table}")


def open_bucketed(spark: SparkSession, path: str, schema: StructType, key: str, buckets: int) -> DataFrame:
    """The table of ``write_bucketed`` with its buckets known to the planner (an empty table has no files)."""
    table = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"{_named(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({_named(key)}) SORTED BY ({_named(key)}) "
              f"INTO {buckets} BUCKETS LOCATION '{where}'")
    df = spark.table(table)
    df.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {table}")
    return df


def bucketed_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Join two bucketed tables bucket by bucket, whatever their size."""
    return left.join(right.hint("merge"), left[_named(left_key)] == right[_named(right_key)], how)
