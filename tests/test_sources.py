"""Sources and sinks: CSV with a byte-order mark, Parquet stage files, sampled stage file."""

import os

from pyspark.sql import functions as F

from shopscope.operators.sampling import hash_split, sample_n
from shopscope.sources import standins
from shopscope.sources.tables import (read_csv_table, read_facts, with_purchase_year,
                                      write_facts)
from tests.conftest import SMALL


def test_csv_with_bom(spark, scratch):
    path = os.path.join(scratch, "translation.csv")
    with open(path, "wb") as f:
        f.write("﻿product_category_name,product_category_name_english\n".encode("utf-8"))
        f.write("beleza_saude,health_beauty\nautomotivo,auto".encode("utf-8"))
    df = read_csv_table(spark, path, "category_translation")
    assert df.columns == ["product_category_name", "product_category_name_english"]
    assert sorted(r[1] for r in df.collect()) == ["auto", "health_beauty"]


def test_csv_timestamps(spark, scratch):
    path = os.path.join(scratch, "orders.csv")
    with open(path, "w") as f:
        f.write("order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
                "order_delivered_carrier_date,order_delivered_customer_date,"
                "order_estimated_delivery_date\n")
        f.write("o1,c1,delivered,2017-10-02 10:56:33,,,,2017-10-18 00:00:00\n")
    r = read_csv_table(spark, path, "orders").first()
    assert str(r["order_purchase_timestamp"]) == "2017-10-02 10:56:33"
    assert r["order_approved_at"] is None


def test_parquet_round_trip_partitioned(spark, scratch):
    fact = standins.fact_table(spark, SMALL)
    out = os.path.join(scratch, "facts")
    write_facts(with_purchase_year(fact), out, partition_by="purchase_year")
    back = read_facts(spark, out)
    assert back.count() == fact.count()
    p = back.where(F.col("purchase_year") == 1997)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in p


def test_sample_stage_file(spark, scratch):
    fact = standins.fact_table(spark, SMALL)
    s = sample_n(fact, 500, ["order_id", "line_number", "product_id", "seller_id"], salt="x")
    out = os.path.join(scratch, "sample")
    write_facts(s, out)
    assert read_facts(spark, out).count() == 500
    again = sample_n(fact, 500, ["order_id", "line_number", "product_id", "seller_id"], salt="x")
    assert sorted(map(tuple, s.select("order_id", "line_number").collect())) == \
        sorted(map(tuple, again.select("order_id", "line_number").collect()))


def test_hash_split_fraction(spark):
    fact = standins.fact_table(spark, SMALL)
    s = hash_split(fact, ["order_id", "line_number", "product_id", "seller_id"], 0.25, salt="56")
    share = s.where(F.col("split") == "test").count() / s.count()
    assert 0.2 < share < 0.3
