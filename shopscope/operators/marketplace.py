"""The ten marketplace tables as one fact table: many-to-many join on the zip prefix, centroids.

Grain of the result: review x payment x item of an order, times every seller with a closed deal and
every location point in the zip of the order's customer. Location and seller attributes therefore
describe the customer's zip, not the seller of the item, and additive measures are repeated by that
fan-out; ``geo_dedupe`` takes one centroid a zip instead of all its points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopscope.operators.joins import join_on, join_with_suffixes

#: A key gets cells of its own if it has more than this share of all joined rows (1 / CELLS).
CELLS = 1024

TABLES = ("order_reviews", "orders", "order_payments", "order_items", "products", "sellers", "geolocation",
          "customers", "closed_deals", "marketing_qualified_leads")


def key_sizes(df: DataFrame, key: str) -> DataFrame:
    """(key, n): rows for each non-null key, combined before the exchange."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def heavy_keys(left_sizes: DataFrame, right_sizes: DataFrame, cells: int = CELLS) -> DataFrame:
    """(key, a, b): keys with more than 1 / cells of all joined rows, to be joined in a x b cells.

    Fewer than ``cells`` keys can hold such a share, so the result may be broadcast. A cell holds about
    1 / cells of the joined rows at most; both sides are split in proportion to their rows, so that
    about the square root of their product is repeated."""
    pairs = left_sizes.join(right_sizes.withColumnRenamed("n", "m"), "key") \
        .withColumn("pairs", F.col("n").cast("double") * F.col("m"))
    total = pairs.agg(F.sum("pairs")).scalar()
    need = F.ceil(F.col("pairs") * cells / total)
    a = F.least(F.greatest(F.ceil(F.sqrt(need * F.col("n") / F.col("m"))), F.lit(1)), F.col("n"), need)
    return pairs.where(F.col("pairs") * cells > total).select(
        "key", a.cast("int").alias("a"), F.ceil(need / a).cast("int").alias("b"))


def fanout_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_sizes: DataFrame | None = None,
                right_sizes: DataFrame | None = None, cells: int = CELLS) -> DataFrame:
    """Inner many-to-many join in which no key's product is the work of one task.

    The rows of a heavy key are dealt by their content into a parts on the left and b on the right;
    each part meets all parts of the other side, so every pair arises once, in a x b separate cells.
    The sizes (``key_sizes``; by default counted on the inputs) only balance the work: estimates
    from narrower tables give the same rows. Both key columns are kept, null keys join nothing; other
    column names must differ. Equal rows of one side share a part."""
    heavy = F.broadcast(heavy_keys(left_sizes if left_sizes is not None else key_sizes(left, left_on),
                                   right_sizes if right_sizes is not None else key_sizes(right, right_on), cells))

    def dealt(df: DataFrame, key: str, own: str, other: str, part: str, copy: str) -> DataFrame:
        parts, copies = (F.coalesce(F.col(c), F.lit(1)) for c in (own, other))
        content = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        return df.join(heavy, df[key] == F.col("key"), "left").select(
            *[df[f"`{c}`"] for c in df.columns], F.pmod(content, parts).cast("int").alias(part),
            F.explode(F.sequence(F.lit(0), copies - 1)).alias(copy))

    lft = dealt(left, left_on, "a", "b", "__i", "__j")
    rgt = dealt(right, right_on, "b", "a", "__jr", "__ir")
    return lft.join(rgt, (lft[left_on] == rgt[right_on]) & (F.col("__i") == F.col("__ir")) & (F.col("__j") == F.col("__jr"))) \
        .drop("__i", "__j", "__ir", "__jr")


def geo_centroids(geolocation: DataFrame) -> DataFrame:
    """One row a zip prefix: mean latitude and longitude, and its most frequent (city, state) (ties: the first).

    Points are combined by (zip, city, state) first, so a zip with most of the rows is no hot group."""
    z, place = "geolocation_zip_code_prefix", ["geolocation_city", "geolocation_state"]
    some = geolocation.where(F.col(z).isNotNull()).groupBy(z, *place).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("geolocation_lat", "geolocation_lng")],
        *[F.count(c).alias(f"n_{c}") for c in ("geolocation_lat", "geolocation_lng")])
    best = F.min_by(F.struct(*place), F.struct((-F.col("n")).alias("n"), *place))
    return some.groupBy(z).agg(
        *[(F.sum(c) / F.nullif(F.sum(f"n_{c}"), F.lit(0))).alias(c) for c in ("geolocation_lat", "geolocation_lng")],
        best.alias("best")).select(z, "geolocation_lat", "geolocation_lng", *[f"best.{c}" for c in place])


def _checked(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    missing = set(TABLES) - set(tables)
    if missing:
        raise ValueError(f"tables missing: {sorted(missing)}")
    return tables


def _dealt(t: dict[str, DataFrame]) -> DataFrame:
    return t["sellers"].join(t["closed_deals"], "seller_id").join(t["marketing_qualified_leads"], "mql_id")


def denormalize(tables: dict[str, DataFrame], geo_dedupe: bool = False, cells: int = CELLS) -> DataFrame:
    """All ten tables as one fact table (``TABLES`` names them; see the module's text for its grain).

    The order branch is joined with its customers first, and sellers with their deals and leads, so the
    many-to-many join on the zip is the last one and no larger product is ever formed. ``seller_id``
    stands in both branches: the order's is ``seller_id_x``, the zip's ``seller_id_y``."""
    t = _checked(tables)
    lines = t["order_reviews"].join(t["orders"], "order_id").join(t["order_payments"], "order_id") \
        .join(t["order_items"], "order_id").join(t["products"], "product_id")
    bought = join_with_suffixes(lines, t["customers"], "customer_id").withColumnRenamed("seller_id", "seller_id_x")
    geo = geo_centroids(t["geolocation"]) if geo_dedupe else t["geolocation"]
    dealt = _dealt(t)
    points = key_sizes(geo, "geolocation_zip_code_prefix")
    near = join_on(dealt, geo, "seller_zip_code_prefix", "geolocation_zip_code_prefix") if geo_dedupe else \
        fanout_join(dealt, geo, "seller_zip_code_prefix", "geolocation_zip_code_prefix", right_sizes=points, cells=cells)
    near = near.withColumnRenamed("seller_id", "seller_id_y")
    # orders are spread over a zip's customers: their number stands for that of the order lines
    per_zip = key_sizes(dealt, "seller_zip_code_prefix").join(points.withColumnRenamed("n", "m"), "key") \
        .select("key", (F.col("n") * F.col("m")).alias("n"))
    return fanout_join(bought, near, "customer_zip_code_prefix", "geolocation_zip_code_prefix",
                       key_sizes(t["customers"], "customer_zip_code_prefix"), per_zip, cells)


def summarize(tables: dict[str, DataFrame], geo_dedupe: bool = False) -> DataFrame:
    """The rows of ``denormalize`` summed by (customer_state, origin), without forming them.

    All rows of a zip's order side meet all rows of its seller side, so a sum over the pairs is the product
    of a sum and a count: both sides are reduced to one row a zip before they meet, and distinct orders and
    sellers are counted over (order, zip) and (seller, zip). The pairs grow with the square of the tables
    (the cube, without centroids); this grows with the tables."""
    t = _checked(tables)
    key = ["customer_state", "origin"]
    one = F.count(F.lit(1))
    geo = geo_centroids(t["geolocation"]) if geo_dedupe else t["geolocation"]
    geo = geo.where(F.col("geolocation_zip_code_prefix").isNotNull()).groupBy(F.col("geolocation_zip_code_prefix").alias("zip")).agg(
        one.alias("points"), F.max("geolocation_city").alias("city"),
        *[f(f"geolocation_{c}").alias(f"{f.__name__}_{c}") for c in ("lat", "lng") for f in (F.sum, F.count)])
    sellers = _dealt(t).select(F.col("seller_zip_code_prefix").alias("zip"), "origin", "seller_id") \
        .groupBy("zip", "origin", "seller_id").agg(one.alias("deals")).join(geo.select("zip", "points"), "zip")
    near = sellers.groupBy("zip", "origin").agg(F.sum("deals").alias("deals")).join(geo, "zip")

    place = t["orders"].select("order_id", "customer_id").join(
        t["customers"].select("customer_id", F.col("customer_zip_code_prefix").alias("zip"), "customer_state").where("zip IS NOT NULL"), "customer_id")
    reviews = t["order_reviews"].groupBy("order_id").agg(one.alias("reviews"))
    payments = t["order_payments"].groupBy("order_id").agg(one.alias("payments"), F.sum("payment_value").alias("paid"))
    items = t["order_items"].select("order_id", "product_id", "seller_id", "price").join(t["products"].select("product_id"), "product_id")
    lines = place.join(reviews, "order_id").join(payments, "order_id").join(items, "order_id") \
        .withColumn("rows", F.col("reviews") * F.col("payments"))
    orders = lines.groupBy("order_id", "zip", "customer_state").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("price") * F.col("rows")).alias("price"),
        F.sum(F.col("paid") * F.col("reviews")).alias("paid"))
    bought = orders.groupBy("zip", "customer_state").agg(*[F.sum(c).alias(c) for c in ("rows", "price", "paid")])

    def mean(c: str):
        met = F.col("rows") * F.col("deals")
        return (F.sum(met * F.col(f"sum_{c}")) / F.nullif(F.sum(met * F.col(f"count_{c}")), F.lit(0))).alias(f"mean_{c}")

    met = F.col("deals") * F.col("points")
    sums = bought.join(near, "zip").groupBy(*key).agg(
        F.sum(F.col("rows") * met).alias("n"), F.sum(F.col("price") * met).alias("total_price"),
        F.sum(F.col("paid") * met).alias("total_paid"), mean("lat"), mean("lng"), F.max("city").alias("last_city"))
    buyers = orders.select("order_id", "zip", "customer_state").join(near.select("zip", "origin"), "zip") \
        .groupBy(*key).agg(F.count_distinct("order_id").alias("orders"))
    met_sellers = bought.select("zip", "customer_state").join(sellers, "zip") \
        .groupBy(*key).agg(F.count_distinct("seller_id").alias("zip_sellers"))
    own = lines.select("zip", "seller_id", "customer_state", "rows").join(sellers, ["zip", "seller_id"]) \
        .groupBy(*key).agg(F.sum(F.col("rows") * met).alias("own_seller_rows"))
    parts = sums.unionByName(buyers, True).unionByName(met_sellers, True).unionByName(own, True)
    names = ["n", "orders", "zip_sellers", "total_price", "total_paid", "mean_lat", "mean_lng", "last_city"]
    return parts.groupBy(*key).agg(*[F.max(c).alias(c) for c in names], F.coalesce(F.max("own_seller_rows"), F.lit(0)).alias("own_seller_rows")) \
        .withColumnsRenamed({"mean_lat": "lat", "mean_lng": "lng"})
