"""Readers and writers: the driver's Parquet tables, the marketplace CSVs, Parquet stage files.

Every reader declares its schema so that no job is spent on inference and a type never
changes with the data.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopscope.session import shared_folder

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (``{sf_dir}/{name}.parquet``)."""
    if name not in DRIVER_TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: read_table(spark, sf_dir, n) for n in names}


# --- the marketplace CSV files -----------------------------------------------------------
# Column names as the data carries them (including the "lenght" misspelling).
_S, _I, _D, _TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


MARKETPLACE_SCHEMAS: dict[str, T.StructType] = {
    "order_reviews": _schema(("review_id", _S), ("order_id", _S), ("review_score", _I),
                             ("review_comment_title", _S), ("review_comment_message", _S),
                             ("review_creation_date", _TS), ("review_answer_timestamp", _TS)),
    "orders": _schema(("order_id", _S), ("customer_id", _S), ("order_status", _S),
                      ("order_purchase_timestamp", _TS), ("order_approved_at", _TS),
                      ("order_delivered_carrier_date", _TS),
                      ("order_delivered_customer_date", _TS),
                      ("order_estimated_delivery_date", _TS)),
    "order_payments": _schema(("order_id", _S), ("payment_sequential", _I),
                              ("payment_type", _S), ("payment_installments", _I),
                              ("payment_value", _D)),
    "order_items": _schema(("order_id", _S), ("order_item_id", _I), ("product_id", _S),
                           ("seller_id", _S), ("shipping_limit_date", _TS), ("price", _D),
                           ("freight_value", _D)),
    "products": _schema(("product_id", _S), ("product_category_name", _S),
                        ("product_name_lenght", _I), ("product_description_lenght", _I),
                        ("product_photos_qty", _I), ("product_weight_g", _I),
                        ("product_length_cm", _I), ("product_height_cm", _I),
                        ("product_width_cm", _I)),
    "sellers": _schema(("seller_id", _S), ("seller_zip_code_prefix", _I), ("seller_city", _S),
                       ("seller_state", _S)),
    "geolocation": _schema(("geolocation_zip_code_prefix", _I), ("geolocation_lat", _D),
                           ("geolocation_lng", _D), ("geolocation_city", _S),
                           ("geolocation_state", _S)),
    "customers": _schema(("customer_id", _S), ("customer_unique_id", _S),
                         ("customer_zip_code_prefix", _I), ("customer_city", _S),
                         ("customer_state", _S)),
    "closed_deals": _schema(("mql_id", _S), ("seller_id", _S), ("sdr_id", _S), ("sr_id", _S),
                            ("won_date", _TS), ("business_segment", _S), ("lead_type", _S),
                            ("lead_behaviour_profile", _S), ("has_company", _S),
                            ("has_gtin", _S), ("average_stock", _S), ("business_type", _S),
                            ("declared_product_catalog_size", _D),
                            ("declared_monthly_revenue", _D)),
    "marketing_qualified_leads": _schema(("mql_id", _S), ("first_contact_date", _TS),
                                         ("landing_page_id", _S), ("origin", _S)),
    "category_translation": _schema(("product_category_name", _S),
                                    ("product_category_name_english", _S)),
}


def read_csv_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A marketplace CSV with a header, read with its declared schema.

    Timestamps in the files are ``yyyy-MM-dd HH:mm:ss``; a value that does not parse becomes
    null (the reader runs in PERMISSIVE mode). A UTF-8 byte-order mark before the first
    header name is stripped by Spark's CSV reader.
    """
    schema = MARKETPLACE_SCHEMAS[name]
    return (spark.read.option("header", True).option("mode", "PERMISSIVE")
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
            .option("encoding", "UTF-8").schema(schema).csv(path))


_LINE = "_bad_line"


def read_csv_checked(spark: SparkSession, path: str, name: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of a marketplace CSV file or folder.

    A line that doesn't fit the declared schema (a value of another type, too few or too many fields) is no
    row with silent nulls: it goes to the second frame as (file, line). The lines are parsed once, into a
    Parquet stage file in the shared folder; write the second frame with ``write_quarantine``."""
    schema = T.StructType([*MARKETPLACE_SCHEMAS[name].fields, T.StructField(_LINE, T.StringType())])
    rows = (spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE)
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("encoding", "UTF-8").schema(schema).csv(path)
            .withColumn("file", F.col("_metadata.file_path")))
    stage = shared_folder(spark, f"csv-{name}")
    rows.write.parquet(stage)
    rows = spark.read.parquet(stage)
    good = rows.where(F.col(_LINE).isNull()).drop(_LINE, "file")
    return good, rows.where(F.col(_LINE).isNotNull()).select("file", F.col(_LINE).alias("line"))


def write_quarantine(bad: DataFrame, path: str) -> DataFrame:
    """Write bad lines to a Parquet table and count them by file: (file, n)."""
    bad.write.mode("append").parquet(path)
    return bad.sparkSession.read.parquet(path).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def read_marketplace(spark: SparkSession, folder: str,
                     file_pattern: str) -> dict[str, DataFrame]:
    """All ten marketplace tables from one folder (``file_pattern`` names a
    table's file by ``{name}``)."""
    names = [n for n in MARKETPLACE_SCHEMAS if n != "category_translation"]
    return {n: read_csv_table(spark, os.path.join(folder, file_pattern.format(name=n)), n)
            for n in names}


# --- stage files ------------------------------------------------------------------------

def write_facts(df: DataFrame, path: str, partition_by: str | None = None,
                mode: str = "overwrite") -> None:
    """Persist a fact table as Parquet, optionally partitioned (e.g. by purchase year)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_purchase_year(df: DataFrame, ts_col: str = "order_purchase_timestamp") -> DataFrame:
    """Adds ``purchase_year`` for use as the partition column of a written fact table."""
    return df.withColumn("purchase_year", F.year(ts_col))
