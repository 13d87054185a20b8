"""Marketplace-shaped frames derived from the driver's TPC-H-like tables.

The marketplace CSVs are not available, so every analysis runs on a fact table with the
same column names, built from ``lineitem, orders, part, supplier, customer, nation``:

==============================  =================================================
marketplace column              stand-in expression
==============================  =================================================
order_id, product_id, seller_id  o_orderkey, l_partkey, l_suppkey
customer_id, customer_unique_id  o_custkey
order_purchase_timestamp         o_orderdate
price                            l_extendedprice
payment_value                    l_extendedprice * (1 - l_discount) * (1 + l_tax)
freight_value                    l_quantity
product_weight_g                 CAST(p_size AS DOUBLE)
product_category_name            p_brand (English name: lower-case, '#' -> '_')
customer_state, geolocation_*    the customer's nation; lat = key*1.5-20, lng = key*2.0-60
zip_code_prefix                  supplier's nation (order side) / customer's nation
==============================  =================================================

The two branches mirror the marketplace build: an order-line branch keyed by customer_id and
a customer-location branch; both carry ``zip_code_prefix`` so the join yields the ``_x`` /
``_y`` pair that ``clean`` resolves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopscope.sources.tables import read_table


def _lines(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """lineitem ⋈ orders ⋈ part ⋈ supplier, with the orders' further columns behind the line's.

    Orders grow with the lines: they are merged at any size, never broadcast, so that what a query shuffles
    grows with its input. Whatever belongs to the orders is joined to them first, where rows are fewer."""
    li = read_table(spark, sf_dir, "lineitem")
    p = read_table(spark, sf_dir, "part")
    s = read_table(spark, sf_dir, "supplier")
    more = [c for c in orders.columns if not c.startswith("o_")]
    return (li.join(orders.hint("merge"), li.l_orderkey == orders.o_orderkey)
            .join(p, li.l_partkey == p.p_partkey)
            .join(s, li.l_suppkey == s.s_suppkey)
            .select(
                F.col("o_orderkey").alias("order_id"),
                F.col("l_linenumber").alias("line_number"),
                F.col("l_partkey").alias("product_id"),
                F.col("l_suppkey").alias("seller_id"),
                F.col("o_custkey").alias("customer_id"),
                F.col("o_orderdate").alias("order_purchase_timestamp"),
                F.col("o_orderstatus").alias("order_status"),
                F.col("o_orderpriority").alias("order_priority"),
                F.col("l_extendedprice").alias("price"),
                (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
                .alias("payment_value"),
                F.col("l_quantity").alias("freight_value"),
                F.col("p_size").cast("double").alias("product_weight_g"),
                F.col("p_brand").alias("product_category_name"),
                F.col("p_type").alias("product_type"),
                F.col("l_discount").alias("discount"),
                F.col("l_tax").alias("tax"),
                F.col("p_retailprice").alias("retail_price"),
                F.col("s_acctbal").alias("seller_balance"),
                F.col("o_totalprice").alias("order_total"),
                F.col("s_nationkey").alias("zip_code_prefix"),
                *more,
            ))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-line branch: lineitem ⋈ orders ⋈ part ⋈ supplier (grain: one line)."""
    return _lines(spark, sf_dir, read_table(spark, sf_dir, "orders"))


def customer_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer branch: customer ⋈ nation (nation has 25 rows: broadcast by construction)."""
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_custkey").alias("customer_unique_id"),
                F.col("c_nationkey").alias("zip_code_prefix"),
                F.col("n_name").alias("customer_state"),
                F.col("n_name").alias("geolocation_state"),
                (F.col("n_nationkey") * 1.5 - 20).alias("geolocation_lat"),
                (F.col("n_nationkey") * 2.0 - 60).alias("geolocation_lng"),
                F.col("c_acctbal").alias("customer_balance"),
                F.col("c_mktsegment").alias("market_segment"),
            ))


def fact_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both branches joined on customer_id; the shared zip column becomes ``_x`` / ``_y``.

    A line's customer is its order's: the orders are joined with the locations before the lines."""
    place = customer_locations(spark, sf_dir).withColumnsRenamed({"customer_id": "o_place", "zip_code_prefix": "zip_code_prefix_y"})
    o = read_table(spark, sf_dir, "orders")
    rows = _lines(spark, sf_dir, o.join(place, o.o_custkey == place.o_place).drop("o_place"))
    rows = rows.withColumnRenamed("zip_code_prefix", "zip_code_prefix_x")
    return rows.select("customer_id", *[c for c in rows.columns if c != "customer_id"])


def fact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table all analyses read: the raw join with the ``_y`` side kept as
    ``zip_code_prefix`` (what ``clean`` does; the driver tables have no nulls, so the rest
    of ``clean`` is a no-op here)."""
    return (fact_raw(spark, sf_dir).drop("zip_code_prefix_x")
            .withColumnRenamed("zip_code_prefix_y", "zip_code_prefix"))


def fact_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw fact plus three columns with missing values, to exercise ``clean``:

    * ``lead_behaviour_profile``: null on ~22 % of rows, else the order status,
    * ``declared_monthly_revenue``: null on ~60 % of rows (to be dropped as a column),
    * ``shipping_limit_date``: null on ~2 % of rows (those rows are dropped).
    The pattern follows the order key, so both engines null exactly the same rows.
    """
    oid = F.pmod(F.col("order_id"), F.lit(90))
    return fact_raw(spark, sf_dir).select(
        "*",
        F.when(oid % 9 < 2, F.lit(None).cast("string"))
        .otherwise(F.col("order_status")).alias("lead_behaviour_profile"),
        F.when(oid % 10 < 6, F.lit(None).cast("double"))
        .otherwise(F.col("price") * 0.1).alias("declared_monthly_revenue"),
        F.when(F.pmod(F.col("order_id"), F.lit(50)) == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.col("order_purchase_timestamp")).alias("shipping_limit_date"),
    )


def category_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup product_category_name -> product_category_name_english, derived from part."""
    p = read_table(spark, sf_dir, "part")
    return (p.select(F.col("p_brand").alias("product_category_name")).distinct()
            .withColumn("product_category_name_english",
                        F.lower(F.regexp_replace("product_category_name", "#", "_"))))


def marketplace_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The ten marketplace tables derived from the driver tables (names as in the CSV schemas).

    A zip prefix is the nation and the last digits of the key, so that sellers, location points and
    customers meet many to many. Nine of ten orders have a review, one of four is paid in two parts, every
    customer is a location point, every third supplier has a closed deal."""
    o, li, p, s, c, n = (read_table(spark, sf_dir, x) for x in ("orders", "lineitem", "part", "supplier", "customer", "nation"))

    def zip_of(nation: str, key: str):
        return (F.col(nation) * 100 + F.pmod(F.col(key), F.lit(20))).cast("int")

    key = F.col("o_orderkey")
    part = F.explode(F.sequence(F.lit(1), F.when(key % 4 == 0, 2).otherwise(1)))
    place = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    deal = s.where("s_suppkey % 3 = 0")
    return {
        "order_reviews": o.where(key % 10 != 0).select(
            F.concat(F.lit("r"), key).alias("review_id"), key.alias("order_id"), (key % 5 + 1).cast("int").alias("review_score")),
        "orders": o.select(key.alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("order_status"),
                           F.col("o_orderdate").alias("order_purchase_timestamp")),
        "order_payments": o.select(key.alias("order_id"), "o_totalprice", part.alias("payment_sequential")).select(
            "order_id", "payment_sequential", F.when(F.col("order_id") % 4 == 0, F.col("o_totalprice") / 2)
            .otherwise(F.col("o_totalprice")).alias("payment_value")),
        "order_items": li.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"),
                                 F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
                                 F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("freight_value")),
        "products": p.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("product_category_name"),
                             F.col("p_size").alias("product_weight_g")),
        "sellers": s.select(F.col("s_suppkey").alias("seller_id"), zip_of("s_nationkey", "s_suppkey").alias("seller_zip_code_prefix")),
        "geolocation": place.select(
            zip_of("c_nationkey", "c_custkey").alias("geolocation_zip_code_prefix"),
            (F.col("c_nationkey") * 1.5 - 20 + (F.col("c_custkey") % 7) * 0.125).alias("geolocation_lat"),
            (F.col("c_nationkey") * 2.0 - 60 + (F.col("c_custkey") % 11) * 0.125).alias("geolocation_lng"),
            F.concat(F.col("n_name"), F.lit(" "), F.col("c_custkey") % 3).alias("geolocation_city"),
            F.col("n_name").alias("geolocation_state")),
        "customers": place.select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_unique_id"),
            zip_of("c_nationkey", "c_custkey").alias("customer_zip_code_prefix"), F.col("n_name").alias("customer_state")),
        "closed_deals": deal.select(F.concat(F.lit("m"), F.col("s_suppkey")).alias("mql_id"), F.col("s_suppkey").alias("seller_id"),
                                    F.element_at(F.array(*[F.lit(x) for x in ("cat", "eagle", "wolf")]), (F.col("s_suppkey") % 3 + 1).cast("int"))
                                    .alias("lead_behaviour_profile")),
        "marketing_qualified_leads": deal.select(
            F.concat(F.lit("m"), F.col("s_suppkey")).alias("mql_id"),
            F.when(F.col("s_suppkey") % 2 == 0, "search").otherwise("social").alias("origin")),
    }
