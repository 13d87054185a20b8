"""The zip fan-out join with a hot zip, centroids, and the ten-table fact over written CSV files."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shopscope.operators import marketplace
from shopscope.sources import standins
from shopscope.sources.tables import read_marketplace
from tests.conftest import MEDIUM


@pytest.fixture(scope="module")
def sides(spark):
    # zip 7 holds a third of both sides; some keys are null, some match nothing, some rows are equal
    left = [(i, 7 if i % 3 == 0 else (None if i % 50 == 1 else i % 40)) for i in range(600)] + [(1, 2), (1, 2)]
    right = [(i, 7 if i % 3 == 0 else (None if i % 50 == 1 else 20 + i % 60), f"p{i}") for i in range(450)] + [(9, 22, "d")] * 2
    return (spark.createDataFrame(left, "line long, zip int"), spark.createDataFrame(right, "seller long, geo_zip int, `a.b` string"),
            left, right)


@pytest.mark.parametrize("cells", [1, 16, 1024])
def test_fanout_join_gives_every_pair_once(sides, cells):
    left, right, a, b = sides
    got = marketplace.fanout_join(left, right, "zip", "geo_zip", cells=cells)
    assert got.columns == ["line", "zip", "seller", "geo_zip", "a.b"]
    want = Counter((*x, *y) for x in a for y in b if x[1] is not None and x[1] == y[1])
    assert Counter(tuple(r) for r in got.collect()) == want


def test_wrong_sizes_change_only_the_balance(spark, sides):
    left, right, a, b = sides
    sizes = spark.createDataFrame([(7, 10 ** 6), (22, 5), (99, 3)], "key int, n long")
    got = marketplace.fanout_join(left, right, "zip", "geo_zip", sizes, sizes, cells=64)
    assert got.count() == sum(x[1] is not None and x[1] == y[1] for x in a for y in b)


def test_cells_bound_the_work_of_a_key(sides):
    left, right, a, b = sides
    cells = 64
    heavy = marketplace.heavy_keys(marketplace.key_sizes(left, "zip"), marketplace.key_sizes(right, "geo_zip"), cells).collect()
    n, m = Counter(z for _, z in a), Counter(z for _, z, _ in b)
    total = sum(n[z] * m[z] for z in n if z is not None)
    assert 0 < len(heavy) < cells and {r.key for r in heavy} >= {7}
    assert all(r.a * r.b >= n[r.key] * m[r.key] * cells / total for r in heavy)
    # the product of a hot key is the work of many tasks
    joined = marketplace.fanout_join(left, right, "zip", "geo_zip", cells=cells)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan
    salted = left.join(F.broadcast(marketplace.heavy_keys(marketplace.key_sizes(left, "zip"), marketplace.key_sizes(right, "geo_zip"), cells)),
                       F.col("zip") == F.col("key")).where("zip = 7")
    parts = salted.groupBy(F.pmod(F.xxhash64("line", "zip"), F.col("a"))).count().collect()
    assert len(parts) > 1 and max(r[1] for r in parts) < 3 * sum(r[1] for r in parts) / len(parts)


def test_centroids(spark):
    rows = [(1, 0.0, 2.0, "b", "S"), (1, 2.0, None, "b", "S"), (1, 4.0, 4.0, "a", "S"), (1, 0.0, 0.0, "a", "S"), (2, None, None, None, None),
            (None, 1.0, 1.0, "x", "X")]
    g = spark.createDataFrame(rows, "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, "
                                    "geolocation_city string, geolocation_state string")
    got = {r[0]: tuple(r)[1:] for r in marketplace.geo_centroids(g).collect()}
    assert got == {1: (1.5, 2.0, "a", "S"), 2: (None, None, None, None)}


def test_denormalize_from_csv_files(spark, tmp_path):
    """The whole way from ten CSV files; the result equals a plain chain of joins."""
    for name, df in standins.marketplace_tables(spark, MEDIUM).items():
        df.toPandas().to_csv(tmp_path / f"{name}.csv", index=False, date_format="%Y-%m-%d %H:%M:%S")
    # the readers declare all columns: the stand-ins' missing ones are added
    from shopscope.sources.tables import MARKETPLACE_SCHEMAS
    import pandas as pd
    for name in marketplace.TABLES:
        path = tmp_path / f"{name}.csv"
        pd.read_csv(path, dtype=str).reindex(columns=MARKETPLACE_SCHEMAS[name].names).to_csv(path, index=False)
    t = read_marketplace(spark, str(tmp_path), "{name}.csv")
    got = marketplace.denormalize(t, cells=32)
    plain = t["order_reviews"].join(t["orders"], "order_id").join(t["order_payments"], "order_id").join(t["order_items"], "order_id") \
        .join(t["products"], "product_id").withColumnRenamed("seller_id", "seller_id_x")
    right = t["sellers"].join(t["geolocation"], F.col("seller_zip_code_prefix") == F.col("geolocation_zip_code_prefix")) \
        .join(t["customers"], F.col("geolocation_zip_code_prefix") == F.col("customer_zip_code_prefix")) \
        .join(t["closed_deals"], "seller_id").join(t["marketing_qualified_leads"], "mql_id").withColumnRenamed("seller_id", "seller_id_y")
    want = plain.join(right, "customer_id")
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))]
    assert want.count() > 100
    assert tuple(got.agg(*digest).first()) == tuple(want.agg(*digest).first())


def test_missing_table_is_named(spark):
    with pytest.raises(ValueError, match="products"):
        marketplace.denormalize({n: None for n in marketplace.TABLES if n != "products"})


@pytest.mark.parametrize("geo_dedupe", [False, True])
def test_summary_equals_the_summed_rows(spark, geo_dedupe):
    """Keys that repeat or are null, zips without sellers, points without a place; no zip's pairs are formed."""
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    tables = {
        "order_reviews": frame([("r1", 1, 5), ("r2", 1, 4), ("r3", 2, 1), ("r4", 3, 1), ("r5", None, 1), ("r6", 4, 2)], "review_id string, order_id long, review_score int"),
        "orders": frame([(1, 10), (2, 11), (2, 11), (3, 12), (4, None), (5, 10)], "order_id long, customer_id long"),
        "order_payments": frame([(1, 1, 2.5), (1, 2, None), (2, 1, 4.0), (3, 1, None), (5, 1, 8.0)], "order_id long, payment_sequential int, payment_value double"),
        "order_items": frame([(1, 7, 100, 1.5), (1, 8, 101, None), (2, 7, 101, 3.0), (3, 8, 102, 2.0), (3, 9, 102, 2.0)], "order_id long, product_id long, seller_id long, price double"),
        "products": frame([(7, "a"), (7, "a"), (8, None), (None, "b")], "product_id long, product_category_name string"),
        "sellers": frame([(100, 1), (101, 1), (101, 2), (102, None), (103, 2)], "seller_id long, seller_zip_code_prefix int"),
        "geolocation": frame([(1, 0.5, 1.0, "x", "S"), (1, None, 2.0, "y", "S"), (2, None, None, None, "T"), (2, None, 4.0, "z", "T"), (None, 1.0, 1.0, "q", "U")],
                             "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, geolocation_city string, geolocation_state string"),
        "customers": frame([(10, 1, "S"), (11, 2, "T"), (11, 1, "T"), (12, 2, None), (13, None, "S")], "customer_id long, customer_zip_code_prefix int, customer_state string"),
        "closed_deals": frame([("m0", 100), ("m1", 101), ("m1", 101), ("m3", 103), ("m4", 102)], "mql_id string, seller_id long"),
        "marketing_qualified_leads": frame([("m0", "search"), ("m1", None), ("m3", "search"), ("m4", "social")], "mql_id string, origin string")}
    got = marketplace.summarize(tables, geo_dedupe)
    want = marketplace.denormalize(tables, geo_dedupe).groupBy("customer_state", "origin").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("order_id").alias("orders"), F.countDistinct("seller_id_y").alias("zip_sellers"),
        F.sum("price").alias("total_price"), F.sum("payment_value").alias("total_paid"), F.avg("geolocation_lat").alias("lat"),
        F.avg("geolocation_lng").alias("lng"), F.max("geolocation_city").alias("last_city"),
        F.sum(F.when(F.col("seller_id_x") == F.col("seller_id_y"), 1).otherwise(0)).alias("own_seller_rows"))
    assert dict(got.dtypes) == dict(want.dtypes)
    rows = {(r.customer_state, r.origin): r.asDict() for r in want.collect()}
    assert len(rows) > 4 and {(r.customer_state, r.origin): r.asDict() for r in got.collect()} == rows


def test_summary_of_a_hot_zip_forms_no_pairs(spark):
    """One zip with 3,000 orders, sellers and points each: 2.7e10 rows of the joined table."""
    many = spark.range(3000)
    key, zip_ = F.col("id"), F.lit(1)
    tables = {
        "order_reviews": many.select(key.alias("order_id")), "orders": many.select(key.alias("order_id"), key.alias("customer_id")),
        "order_payments": many.select(key.alias("order_id"), F.lit(2.0).alias("payment_value")),
        "order_items": many.select(key.alias("order_id"), F.lit(1).alias("product_id"), key.alias("seller_id"), F.lit(0.5).alias("price")),
        "products": many.limit(1).select(F.lit(1).alias("product_id")), "sellers": many.select(key.alias("seller_id"), zip_.alias("seller_zip_code_prefix")),
        "geolocation": many.select(zip_.alias("geolocation_zip_code_prefix"), key.cast("double").alias("geolocation_lat"), F.lit(1.0).alias("geolocation_lng"),
                                   F.lit("c").alias("geolocation_city"), F.lit("s").alias("geolocation_state")),
        "customers": many.select(key.alias("customer_id"), zip_.alias("customer_zip_code_prefix"), F.lit("s").alias("customer_state")),
        "closed_deals": many.select(key.alias("mql_id"), key.alias("seller_id")), "marketing_qualified_leads": many.select(key.alias("mql_id"), F.lit("o").alias("origin"))}
    r = marketplace.summarize(tables).first()
    assert (r.n, r.orders, r.zip_sellers, r.own_seller_rows) == (3000 ** 3, 3000, 3000, 3000 * 3000)
    assert (r.total_price, r.total_paid, r.lat, r.lng) == (3000 ** 3 * 0.5, 3000 ** 3 * 2.0, 1499.5, 1.0)
