"""DuckDB twins of the registered queries (independent SQL over the same Parquet views).

Conventions shared with the Spark side: floating results rounded to 4 digits (2 for sums
that exceed 1e6), months/years as INTEGER, counts as BIGINT, dates as 'YYYY-MM-DD' text.
"""

from __future__ import annotations

# The stand-in fact table (see shopscope.sources.standins) as a CTE body.
FACT = """
SELECT o.o_orderkey AS order_id, l.l_linenumber AS line_number, l.l_partkey AS product_id,
       l.l_suppkey AS seller_id, o.o_custkey AS customer_id, o.o_custkey AS customer_unique_id,
       o.o_orderdate AS order_purchase_timestamp, o.o_orderstatus AS order_status,
       o.o_orderpriority AS order_priority, l.l_extendedprice AS price,
       l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax) AS payment_value,
       l.l_quantity AS freight_value, CAST(p.p_size AS DOUBLE) AS product_weight_g,
       p.p_brand AS product_category_name, p.p_type AS product_type,
       l.l_discount AS discount, l.l_tax AS tax, p.p_retailprice AS retail_price,
       s.s_acctbal AS seller_balance, o.o_totalprice AS order_total,
       s.s_nationkey AS zip_code_prefix_x, c.c_nationkey AS zip_code_prefix_y,
       n.n_name AS customer_state, n.n_name AS geolocation_state,
       n.n_nationkey * CAST(1.5 AS DOUBLE) - 20 AS geolocation_lat, n.n_nationkey * CAST(2.0 AS DOUBLE) - 60 AS geolocation_lng,
       c.c_acctbal AS customer_balance, c.c_mktsegment AS market_segment
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

FACT_CLEAN = """
SELECT * EXCLUDE (zip_code_prefix_x, zip_code_prefix_y), zip_code_prefix_y AS zip_code_prefix
FROM fact_raw
"""

TRANSLATION = """
SELECT DISTINCT p_brand AS product_category_name,
       lower(replace(p_brand, '#', '_')) AS product_category_name_english
FROM part
"""


def with_fact(body: str, extra: str = "") -> str:
    """Prefix a query with the fact CTEs (``fact_raw``, ``fact``, ``translation``)."""
    ctes = [f"fact_raw AS ({FACT})", f"fact AS ({FACT_CLEAN})", f"translation AS ({TRANSLATION})"]
    if extra:
        ctes.append(extra)
    return "WITH " + ",\n".join(ctes) + "\n" + body


GAPS = """
SELECT *,
  CASE WHEN (order_id % 90) % 9 < 2 THEN NULL ELSE order_status END AS lead_behaviour_profile,
  CASE WHEN (order_id % 90) % 10 < 6 THEN NULL ELSE price * 0.1 END AS declared_monthly_revenue,
  CASE WHEN order_id % 50 = 0 THEN NULL ELSE order_purchase_timestamp END AS shipping_limit_date
FROM fact_raw
"""

FACT_RAW_COLUMNS = (
    "customer_id", "order_id", "line_number", "product_id", "seller_id",
    "order_purchase_timestamp", "order_status", "order_priority", "price", "payment_value",
    "freight_value", "product_weight_g", "product_category_name", "product_type", "discount",
    "tax", "retail_price", "seller_balance", "order_total", "zip_code_prefix_x",
    "customer_unique_id", "zip_code_prefix_y", "customer_state", "geolocation_state",
    "geolocation_lat", "geolocation_lng", "customer_balance", "market_segment")
GAP_COLUMNS = ("lead_behaviour_profile", "declared_monthly_revenue", "shipping_limit_date")

ROW_KEYS = "order_id, line_number, product_id, seller_id"
NUMERIC = ("price", "payment_value", "freight_value", "product_weight_g", "discount", "tax",
           "retail_price", "seller_balance", "order_total", "customer_balance",
           "geolocation_lat", "geolocation_lng")
PROFILE_STRINGS = ("customer_state", "product_category_name", "product_type", "order_status",
                   "order_priority", "market_segment")


def ts_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def bucket(keys: str = ROW_KEYS, salt: str = "", n: int = 100) -> str:
    text = f"concat_ws('|', {keys})"
    if salt:
        text = f"'{salt}' || {text}"
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {n})"


def register(name: str, sql: str) -> None:
    SQL[name] = sql


SQL: dict[str, str] = {}

# --- sources, joins, cleaning -------------------------------------------------------------

register("denormalize_facts", with_fact(f"""
SELECT {ROW_KEYS}, customer_unique_id,
       CAST(CAST(order_purchase_timestamp AS DATE) AS VARCHAR) AS purchase_date,
       price, payment_value, freight_value, product_weight_g,
       product_category_name, customer_state, zip_code_prefix_x, zip_code_prefix_y
FROM fact_raw"""))

register("zip_fanout_counts", """
SELECT n.n_name AS state, count(DISTINCT s.s_suppkey) AS sellers,
       count(DISTINCT c.c_custkey) AS customers, count(*) AS pairs
FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey
JOIN nation n ON n.n_nationkey = s.s_nationkey
GROUP BY n.n_name""")



def _marketplace_sql(geo: str) -> str:
    return f"""
WITH geo0 AS (
  SELECT c_nationkey * 100 + c_custkey % 20 AS zip, c_nationkey * CAST(1.5 AS DOUBLE) - 20 + (c_custkey % 7) * CAST(0.125 AS DOUBLE) AS lat,
         c_nationkey * CAST(2.0 AS DOUBLE) - 60 + (c_custkey % 11) * CAST(0.125 AS DOUBLE) AS lng,
         n_name || ' ' || (c_custkey % 3) AS city, n_name AS state
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), geo AS ({geo}
), pay AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 2 ELSE o_totalprice END AS payment_value,
                  unnest(range(CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END)) AS part FROM orders
), near AS (
  SELECT s_suppkey AS seller_id_y, geo.*, CASE WHEN s_suppkey % 2 = 0 THEN 'search' ELSE 'social' END AS origin
  FROM supplier JOIN geo ON geo.zip = s_nationkey * 100 + s_suppkey % 20 WHERE s_suppkey % 3 = 0
)
SELECT n_name AS customer_state, origin, count(*) AS n, count(DISTINCT o_orderkey) AS orders, count(DISTINCT seller_id_y) AS zip_sellers,
       round(sum(l_extendedprice), 2) AS total_price, round(sum(payment_value), 2) AS total_paid, round(avg(lat), 4) AS lat,
       round(avg(lng), 4) AS lng, max(city) AS last_city, CAST(sum(CASE WHEN l_suppkey = seller_id_y THEN 1 ELSE 0 END) AS BIGINT) AS own_seller_rows
FROM orders JOIN pay ON pay.order_id = o_orderkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN near ON near.zip = c_nationkey * 100 + c_custkey % 20
WHERE o_orderkey % 10 <> 0
GROUP BY n_name, origin"""


register("denormalize_marketplace", _marketplace_sql("SELECT * FROM geo0"))
register("denormalize_geo_dedupe", _marketplace_sql("""
  SELECT zip, avg(lat) AS lat, avg(lng) AS lng,
         (SELECT city FROM geo0 g WHERE g.zip = geo0.zip GROUP BY city ORDER BY count(*) DESC, city LIMIT 1) AS city, max(state) AS state
  FROM geo0 GROUP BY zip"""))

register("category_lookup_join", with_fact("""
SELECT t.product_category_name_english AS category, count(*) AS n,
       round(sum(f.price), 2) AS total_price
FROM fact f JOIN translation t USING (product_category_name)
GROUP BY 1"""))


def _clean_select() -> str:
    cols = []
    for c in FACT_RAW_COLUMNS + GAP_COLUMNS:
        if c in ("zip_code_prefix_x", "declared_monthly_revenue"):
            continue  # dropped: suffix _x / more than half null
        name = "zip_code_prefix" if c == "zip_code_prefix_y" else c
        if c in ("order_purchase_timestamp", "shipping_limit_date"):
            cols.append(f"{ts_text(c)} AS {name}")
        elif c == "lead_behaviour_profile":
            cols.append(f"coalesce({c}, (SELECT v FROM mode)) AS {name}")
        else:
            cols.append(f"{c} AS {name}")
    return ",\n       ".join(cols)


register("clean_columns_rows", with_fact(f"""
SELECT {_clean_select()}
FROM kept""", extra=f"""gaps AS ({GAPS}),
kept AS (SELECT * FROM gaps WHERE shipping_limit_date IS NOT NULL),
mode AS (SELECT lead_behaviour_profile AS v FROM kept WHERE lead_behaviour_profile IS NOT NULL
         GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""))

register("null_fractions", with_fact("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) "
    f"AS null_fraction FROM gaps" for c in FACT_RAW_COLUMNS + GAP_COLUMNS),
    extra=f"gaps AS MATERIALIZED ({GAPS})"))

# --- profiling ----------------------------------------------------------------------------

register("column_profile", with_fact("\nUNION ALL\n".join(f"""
SELECT '{c}' AS column, count({c}) AS n, count(*) - count({c}) AS n_null,
       round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_pct,
       count(DISTINCT {c}) AS n_distinct, round(avg({c}), 4) AS mean,
       round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max,
       round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50,
       round(quantile_cont({c}, 0.75), 4) AS p75
FROM f""" for c in NUMERIC), extra="f AS MATERIALIZED (SELECT * FROM fact)"))

_REPORT_TYPES = {**dict.fromkeys(("customer_id", "order_id", "product_id", "seller_id", "customer_unique_id"), "bigint"),
                 **dict.fromkeys(("line_number", "zip_code_prefix_x", "zip_code_prefix_y"), "int"),
                 **dict.fromkeys(NUMERIC + ("declared_monthly_revenue",), "double"),
                 **dict.fromkeys(("order_purchase_timestamp", "shipping_limit_date"), "timestamp_ntz")}


def _report_sql(columns, top: int) -> str:
    rows = []
    for c in columns:
        dtype = _REPORT_TYPES.get(c, "string")
        number = dtype in ("bigint", "int", "double")
        text = (f"CAST(CAST({c} AS DECIMAL(38,6)) AS VARCHAR)" if number else
                f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" if dtype == "timestamp_ntz" else c)
        x, t = (f"CAST({c} AS DOUBLE)", "CAST(NULL AS VARCHAR)") if number else ("CAST(NULL AS DOUBLE)", text)
        rows.append(f"""
SELECT '{c}' AS "column", '{dtype}' AS dtype, count({c}) AS n, count(*) - count({c}) AS n_null,
       round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_pct, count(DISTINCT {c}) AS n_distinct,
       round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std, round(min({x}), 4) AS min, round(max({x}), 4) AS max,
       round(quantile_cont({x}, 0.25), 4) AS p25, round(quantile_cont({x}, 0.5), 4) AS p50, round(quantile_cont({x}, 0.75), 4) AS p75,
       min({t}) AS min_text, max({t}) AS max_text,
       (SELECT string_agg(v || ':' || m, '; ' ORDER BY m DESC, v) FROM (
          SELECT {text} AS v, count(*) AS m FROM gaps WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY m DESC, v LIMIT {top})) AS top
FROM gaps""")
    return with_fact("\nUNION ALL\n".join(rows), extra=f"gaps AS MATERIALIZED ({GAPS})")


register("column_report", _report_sql(FACT_RAW_COLUMNS + GAP_COLUMNS, 5))
register("column_report_numeric", _report_sql(
    [c for c in FACT_RAW_COLUMNS + GAP_COLUMNS if _REPORT_TYPES.get(c) in ("bigint", "int", "double")], 2))

register("top_values", with_fact(f"""
SELECT "column", value, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT "column", value, n,
         row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank
  FROM ({' UNION ALL '.join(
      f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM f "
      f"WHERE {c} IS NOT NULL GROUP BY 2" for c in PROFILE_STRINGS)})
) WHERE rank <= 5""", extra="f AS MATERIALIZED (SELECT * FROM fact)"))


def _describe(col: str, src: str, by: str | None = None) -> str:
    keys = f"{by}, " if by else ""
    where = f"WHERE {by} IS NOT NULL" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {keys}count({col}) AS count, round(avg({col}), 4) AS mean,
       round(stddev_samp({col}), 4) AS std, round(CAST(min({col}) AS DOUBLE), 4) AS min,
       round(quantile_cont({col}, 0.25), 4) AS p25, round(quantile_cont({col}, 0.5), 4) AS p50,
       round(quantile_cont({col}, 0.75), 4) AS p75, round(CAST(max({col}) AS DOUBLE), 4) AS max
FROM {src} {where} {group}"""


register("describe_price", with_fact(_describe("price", "fact")))
register("describe_by_segment", with_fact(_describe("payment_value", "fact", "market_segment")))

register("price_histogram", with_fact("""
SELECT bin, round(mn + bin * ((mx - mn) / 10.0), 4) AS lo,
       round(mn + (bin + 1) * ((mx - mn) / 10.0), 4) AS hi, count(*) AS n
FROM (
  SELECT CAST(CASE WHEN (b.mx - b.mn) / 10.0 > 0
                   THEN least(floor((f.price - b.mn) / ((b.mx - b.mn) / 10.0)), 9) ELSE 0 END
              AS INTEGER) AS bin, b.mn, b.mx
  FROM fact f, (SELECT min(price) AS mn, max(price) AS mx FROM fact) b
  WHERE f.price IS NOT NULL)
GROUP BY bin, mn, mx"""))

register("csv_quarantine", f"""
SELECT kind, count(*) AS n, CASE WHEN kind <> 'bad' THEN {ts_text('min(o_orderdate)')} END AS first, max(o_orderkey) AS last_order
FROM (SELECT *, CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 101 = 0 OR o_orderkey % 103 = 0 THEN 'bad' ELSE o_orderstatus END AS kind
      FROM orders) GROUP BY kind""")

register("fact_summary", with_fact("""
SELECT CAST(min(CAST(order_purchase_timestamp AS DATE)) AS VARCHAR) AS min_date,
       CAST(max(CAST(order_purchase_timestamp AS DATE)) AS VARCHAR) AS max_date,
       count(DISTINCT customer_unique_id) AS unique_customers,
       round(coalesce(sum(price), 0), 2) AS total_sales
FROM fact"""))

# --- exploration --------------------------------------------------------------------------

TYPE_CATEGORIES = ("STANDARD", "SMALL", "ECONOMY", "MEDIUM", "PROMO")

register("monthly_category_counts", with_fact("\nUNION ALL\n".join(f"""
SELECT '{c}' AS category, CAST(month(order_purchase_timestamp) AS INTEGER) AS month,
       count(*) AS n
FROM fact
WHERE year(order_purchase_timestamp) = 1997 AND contains(product_type, '{c}')
GROUP BY 2""" for c in TYPE_CATEGORIES)))

register("counts_by_state", with_fact("""
SELECT customer_state AS state, count(customer_unique_id) AS n
FROM fact WHERE customer_state IS NOT NULL GROUP BY 1"""))

register("state_value_counts", with_fact("""
SELECT customer_state AS state, count(*) AS n
FROM fact WHERE customer_state IS NOT NULL GROUP BY 1"""))

register("state_bubbles", with_fact("""
SELECT customer_state AS state, count(customer_unique_id) AS n,
       round(avg(geolocation_lat), 4) AS lat, round(avg(geolocation_lng), 4) AS lng,
       round(CAST(count(customer_unique_id) AS DOUBLE) * 20.0, 4) AS radius
FROM fact WHERE customer_state IS NOT NULL GROUP BY 1"""))

register("best_sellers", with_fact("""
SELECT product_category_name, round(coalesce(sum(price), 0), 2) AS total
FROM fact WHERE product_category_name IS NOT NULL
GROUP BY 1 ORDER BY coalesce(sum(price), 0) DESC, 1 LIMIT 10"""))

TOP10 = """top10 AS (
  SELECT product_category_name, CAST(row_number() OVER (ORDER BY total DESC, product_category_name) AS INTEGER) AS rank
  FROM (SELECT product_category_name, coalesce(sum(price), 0) AS total FROM fact
        JOIN translation USING (product_category_name)
        GROUP BY product_category_name ORDER BY total DESC, product_category_name LIMIT 10)),
best_months AS (
  SELECT p.rank, t.product_category_name_english AS category,
         CAST(month(f.order_purchase_timestamp) AS INTEGER) AS month, sum(f.price) AS total
  FROM fact f JOIN translation t USING (product_category_name) JOIN top10 p USING (product_category_name)
  GROUP BY ALL)"""

register("best_seller_monthly", with_fact("SELECT month, " + ", ".join(
    f"round(sum(CASE WHEN rank = {i} THEN total END), 2) AS top_{i:02d}" for i in range(1, 11)
) + " FROM best_months GROUP BY month", extra=TOP10))

register("best_seller_monthly_long", with_fact(
    "SELECT rank, category, month, round(total, 2) AS total FROM best_months", extra=TOP10))

register("orders_per_period", with_fact("""
SELECT CAST(year(order_purchase_timestamp) AS INTEGER) AS year,
       CAST(month(order_purchase_timestamp) AS INTEGER) AS month, count(order_id) AS n,
       CAST(month(order_purchase_timestamp) AS VARCHAR) || '/' ||
       CAST(year(order_purchase_timestamp) AS VARCHAR) AS period
FROM fact GROUP BY 1, 2, 4"""))

# --- statistics ---------------------------------------------------------------------------

PERFECT = 1e-12


def _pairs_sql(pairs) -> str:
    aggs, rows = [], []
    for i, (a, b) in enumerate(pairs):
        cond = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        aggs.append(f"covar_pop({a}, {b}) {cond} AS cov{i}, stddev_pop({a}) {cond} AS sa{i}, "
                    f"stddev_pop({b}) {cond} AS sb{i}")
        rows.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                    f"cov{i} / nullif(sa{i} * sb{i}, 0) AS corr FROM m")
    return ("m AS MATERIALIZED (SELECT " + ",\n  ".join(aggs) + " FROM fact),\n"
            "pairs AS (" + "\nUNION ALL\n".join(rows) + ")")


_UPPER = [(NUMERIC[i], NUMERIC[j]) for i in range(len(NUMERIC)) for j in range(i, len(NUMERIC))]
_MATRIX = """full_m AS (
  SELECT col_a, col_b, corr FROM pairs
  UNION ALL SELECT col_b, col_a, corr FROM pairs WHERE col_a <> col_b)"""

register("corr_matrix", with_fact("SELECT col_a, col_b, round(corr, 6) AS corr FROM full_m",
                                  extra=_pairs_sql(_UPPER) + ",\n" + _MATRIX))

register("corr_pairs", with_fact(f"""
SELECT col_a, col_b, round(corr, 6) AS corr FROM full_m
WHERE col_a <> col_b AND corr IS NOT NULL AND corr < 1 - {PERFECT} AND abs(corr) > 0.3""",
                                 extra=_pairs_sql(_UPPER) + ",\n" + _MATRIX))

register("target_corr", with_fact(f"""
SELECT col_a AS feature, round(corr, 6) AS corr, round(abs(corr), 6) AS abs_corr FROM pairs
WHERE abs(corr) > 0.3 AND abs(corr) < 1 - {PERFECT}""",
                                  extra=_pairs_sql([(c, "price") for c in NUMERIC if c != "price"])))

register("explained_variance_2d", with_fact("""
SELECT component, round(pct_variance, 4) AS pct_variance, round(cum_pct, 4) AS cum_pct FROM (
  SELECT 1 AS component, 50.0 * (1 + abs(r)) AS pct_variance, 50.0 * (1 + abs(r)) AS cum_pct FROM c
  UNION ALL
  SELECT 2, 50.0 * (1 - abs(r)), 100.0 FROM c)""", extra="""c AS (
  SELECT covar_pop(price, payment_value) / (stddev_pop(price) * stddev_pop(payment_value)) AS r
  FROM fact WHERE price IS NOT NULL AND payment_value IS NOT NULL)"""))



def _eigen_sql(sweeps: int = 12) -> str:
    """Cyclic Jacobi rotations of the correlation matrix (a list of p x p numbers), one a recursion step."""
    p = len(NUMERIC)
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
    entries = " UNION ALL ".join(f"SELECT '{a}' AS c, {i} AS i" for i, a in enumerate(NUMERIC))
    extra = _pairs_sql(_UPPER) + ",\n" + _MATRIX + f""",
num AS ({entries}),
start AS MATERIALIZED (SELECT list(corr ORDER BY x.i, y.i) AS m FROM full_m JOIN num x ON x.c = col_a JOIN num y ON y.c = col_b)"""
    body = f"""
SELECT CAST(component AS INTEGER) AS component, round(100 * e / {p}, 4) AS pct_variance,
       round(100 * sum(e) OVER (ORDER BY component) / {p}, 4) AS cum_pct
FROM (SELECT row_number() OVER (ORDER BY e DESC) AS component, e FROM (
  SELECT unnest(list_transform(range({p}), lambda i: m[i * {p} + i + 1])) AS e FROM rotated WHERE step = {sweeps * len(pairs)}))"""
    rotated = f"""rotated AS (
  SELECT 0 AS step, m FROM start
  UNION ALL
  SELECT step + 1, list_transform(range({p * p}), lambda z:
    CASE WHEN z // {p} = p THEN c * b[p * {p} + z % {p} + 1] - s * b[q * {p} + z % {p} + 1]
         WHEN z // {p} = q THEN s * b[p * {p} + z % {p} + 1] + c * b[q * {p} + z % {p} + 1] ELSE b[z + 1] END)
  FROM (SELECT step, p, q, c, s, list_transform(range({p * p}), lambda z:
          CASE WHEN z % {p} = p THEN c * m[z + 1] - s * m[z - p + q + 1]
               WHEN z % {p} = q THEN s * m[z - q + p + 1] + c * m[z + 1] ELSE m[z + 1] END) AS b
        FROM (SELECT *, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS s
              FROM (SELECT *, CASE WHEN abs(m[p * {p} + q + 1]) < 1e-300 THEN 0 ELSE
                       (CASE WHEN th >= 0 THEN 1 ELSE -1 END) / (abs(th) + sqrt(th * th + 1)) END AS t
                    FROM (SELECT *, CASE WHEN abs(m[p * {p} + q + 1]) < 1e-300 THEN 0 ELSE
                             (m[q * {p} + q + 1] - m[p * {p} + p + 1]) / (2 * m[p * {p} + q + 1]) END AS th
                          FROM (SELECT step, m, {[a for a, _ in pairs]}[step % {len(pairs)} + 1] AS p,
                                       {[b for _, b in pairs]}[step % {len(pairs)} + 1] AS q
                                FROM rotated WHERE step < {sweeps * len(pairs)}))))))"""
    return with_fact(body, extra=extra + ",\n" + rotated).replace("WITH ", "WITH RECURSIVE ", 1)


register("explained_variance", _eigen_sql())


def _tree_sql(label: str, depth: int, digits: int = 12) -> str:
    """Splits level by level: class counts below and above each value of each feature in each node."""
    feats = list(NUMERIC)
    stack = "[" + ", ".join(f"struct_pack(f := {i}, x := CAST({c} AS DOUBLE))" for i, c in enumerate(feats)) + "]"
    parts = [f"n0 AS MATERIALIZED (SELECT 1 AS node, {label} AS label, {stack} AS xs FROM fact)"]
    for d in range(depth):
        parts.append(f"""s{d} AS MATERIALIZED (
  SELECT node, arg_min(f, k) AS f, arg_min(x, k) AS x, min(n) AS n, -min(k).d AS d FROM (
    SELECT *, struct_pack(d := -d, f := f, x := x) AS k FROM (
      SELECT node, f, x, any_value(n) AS n, round((sum(l ^ 2) / any_value(nl) + sum((t - l) ^ 2) / nullif(any_value(n - nl), 0)
             - sum(t ^ 2) / any_value(n)) / any_value(n), {digits}) AS d
      FROM (SELECT *, sum(l) OVER (PARTITION BY node, f, x) AS nl, sum(t) OVER (PARTITION BY node, f, x) AS n FROM (
        SELECT node, f, x, label, CAST(sum(c) OVER (PARTITION BY node, f, label ORDER BY x) AS DOUBLE) AS l,
               CAST(sum(c) OVER (PARTITION BY node, f, label) AS DOUBLE) AS t
        FROM (SELECT g.node, g.f, g.x, k.label, coalesce(h.c, 0) AS c
              FROM (SELECT DISTINCT node, xs.f AS f, xs.x AS x FROM (SELECT node, unnest(xs) AS xs FROM n{d})) g
              CROSS JOIN (SELECT DISTINCT label FROM n0) k
              LEFT JOIN (SELECT node, xs.f AS f, xs.x AS x, label, count(*) AS c FROM (SELECT node, label, unnest(xs) AS xs FROM n{d}) GROUP BY ALL) h
              ON h.node = g.node AND h.f = g.f AND h.x = g.x AND h.label = k.label)))
      GROUP BY node, f, x) WHERE d > 0) GROUP BY node)""")
        parts.append(f"""n{d + 1} AS MATERIALIZED (SELECT 2 * n.node + CASE WHEN n.xs[s.f + 1].x <= s.x THEN 0 ELSE 1 END AS node, label, xs
  FROM n{d} n JOIN s{d} s USING (node))""")
    names = " UNION ALL ".join(f"SELECT {i} AS f, '{c}' AS feature" for i, c in enumerate(feats))
    gains = " UNION ALL ".join(f"SELECT f, n * d AS g FROM s{d}" for d in range(depth))
    return with_fact(f"""
SELECT feature, round(coalesce(g, 0) / (SELECT sum(g) FROM gains), 6) AS importance
FROM ({names}) LEFT JOIN (SELECT f, sum(g) AS g FROM gains GROUP BY f) USING (f)""",
                     extra=",\n".join(parts) + f",\ngains AS MATERIALIZED ({gains})")


register("tree_importance_exact", _tree_sql("order_status", 3))

# --- sampling and splits ------------------------------------------------------------------

register("sample_exact", with_fact(f"""
SELECT {ROW_KEYS}, price FROM fact
ORDER BY md5('s1' || concat_ws('|', {ROW_KEYS})), {ROW_KEYS} LIMIT 1000"""))

register("hash_split_counts", with_fact(f"""
SELECT CASE WHEN {bucket()} < 20 THEN 'test' ELSE 'train' END AS split, count(*) AS n,
       round(sum(price), 2) AS total_price
FROM fact GROUP BY 1"""))

# --- customer value -----------------------------------------------------------------------

MEASURES = """clv AS (SELECT order_id, product_id, order_purchase_timestamp, payment_value, price,
                customer_unique_id, geolocation_state, line_number, seller_id FROM fact),
per0 AS MATERIALIZED (
  SELECT customer_unique_id, max(order_purchase_timestamp) AS last_purchase,
         count(order_purchase_timestamp) AS frequency,
         round(coalesce(sum(payment_value), 0), 2) AS revenue, count(*) AS rows
  FROM clv WHERE customer_unique_id IS NOT NULL GROUP BY 1),
per AS MATERIALIZED (
  SELECT p.*, CAST(date_sub('day', p.last_purchase, g.latest) AS INTEGER) AS recency
  FROM per0 p, (SELECT max(last_purchase) AS latest FROM per0) g)"""

register("customer_recency", with_fact(f"""
SELECT customer_unique_id, {ts_text('last_purchase')} AS last_purchase, recency FROM per""",
                                       extra=MEASURES))
register("customer_frequency", with_fact("SELECT customer_unique_id, frequency FROM per",
                                         extra=MEASURES))
register("customer_revenue", with_fact("SELECT customer_unique_id, revenue FROM per",
                                       extra=MEASURES))
register("recency_describe", with_fact(_describe("recency", "clv JOIN per USING (customer_unique_id)"),
                                       extra=MEASURES))



def _describe_measures(src: str) -> str:
    """Describe of several (group key, column) pairs, doubles to 2 digits."""
    return "\nUNION ALL\n".join(f"""
SELECT '{m}' AS measure, count({m}) AS count, round(avg({m}), 2) AS mean, round(stddev_samp({m}), 2) AS std,
       round(CAST(min({m}) AS DOUBLE), 2) AS min, round(quantile_cont({m}, 0.25), 2) AS p25,
       round(quantile_cont({m}, 0.5), 2) AS p50, round(quantile_cont({m}, 0.75), 2) AS p75,
       round(CAST(max({m}) AS DOUBLE), 2) AS max
FROM {src}""" for m in ("recency", "frequency", "revenue"))


register("measure_describe", with_fact(_describe_measures("clv JOIN per USING (customer_unique_id)"),
                                       extra=MEASURES))



def _auto_histogram_sql(measure: str, digits: int = 4, most: int = 1000) -> str:
    return with_fact(f"""
SELECT bin, round(lo + bin * (extent / bins), {digits}) AS lo, round(lo + (bin + 1) * (extent / bins), {digits}) AS hi,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT CAST(CASE WHEN extent > 0 THEN least(floor((x - lo) / (extent / bins)), bins - 1) ELSE 0 END AS INTEGER) AS bin,
             lo, extent, bins FROM v, rule)
GROUP BY bin, lo, extent, bins""", extra=MEASURES + f""",
v AS MATERIALIZED (SELECT CAST({measure} AS DOUBLE) AS x FROM clv JOIN per USING (customer_unique_id)),
spread AS (SELECT min(x) AS lo, max(x) - min(x) AS extent, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr,
                  CAST(count(*) AS DOUBLE) AS n FROM v),
widths AS (SELECT *, extent / (log2(n) + 1) AS sturges, 2 * iqr * n ^ (-1.0 / 3) AS fd FROM spread),
rule AS MATERIALIZED (SELECT lo, extent, CASE WHEN extent > 0 THEN least(ceil(extent / CASE WHEN iqr > 0 THEN least(fd, sturges)
                             ELSE sturges END), {most}) ELSE 1 END AS bins FROM widths)""")


register("recency_histogram", _auto_histogram_sql("recency"))
register("frequency_histogram", _auto_histogram_sql("frequency"))
register("revenue_histogram", _auto_histogram_sql("revenue", 2))

register("event_recency_days", f"""
WITH per AS (SELECT user_id, max(ts) AS last_ts FROM events WHERE user_id IS NOT NULL GROUP BY 1),
g AS (SELECT max(last_ts) AS latest FROM per)
SELECT user_id, {ts_text('last_ts')} AS last_ts,
       CAST(date_sub('day', last_ts, latest) AS INTEGER) AS recency_days,
       CAST(date_diff('day', CAST(last_ts AS DATE), CAST(latest AS DATE)) AS INTEGER) AS calendar_days
FROM per, g""")


def best_ctes(p: str, hist: str, most: int) -> list[str]:
    """Dynamic programming over a (value, weight) CTE for 1 .. ``most`` clusters.

    ``{p}_h``: running sums; ``{p}_d{j}``: least sum of squares of the first i values in j
    ranges, with the last border (ties: the first)."""
    ctes = [f"""{p}_h AS MATERIALIZED (
  SELECT 0 AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS s, 0.0::DOUBLE AS q
  UNION ALL
  SELECT row_number() OVER o, sum(weight) OVER o, sum(weight * (value - m)) OVER o, sum(weight * (value - m) ^ 2) OVER o
  FROM {hist}, (SELECT round(sum(weight * value) / sum(weight)) AS m FROM {hist})
  WINDOW o AS (ORDER BY value ROWS UNBOUNDED PRECEDING))""",
            f"{p}_d1 AS MATERIALIZED (SELECT i, struct_pack(d := q - s ^ 2 / w, l := 0) AS r FROM {p}_h WHERE i > 0)"]
    for j in range(2, most + 1):
        ctes.append(f"""{p}_d{j} AS MATERIALIZED (
  SELECT b.i, min(struct_pack(d := c.r.d + greatest(b.q - a.q - (b.s - a.s) ^ 2 / (b.w - a.w), 0), l := a.i)) AS r
  FROM {p}_h b JOIN {p}_h a ON a.i < b.i JOIN {p}_d{j - 1} c ON c.i = a.i GROUP BY b.i)""")
    return ctes


def centre_ctes(p: str, hist: str, k: int) -> tuple[list[str], str]:
    """One row of ascending centres c0 .. c{k-1} of the best clustering (null: fewer values)."""
    ctes = [f"{p}_b{k}_{k} AS MATERIALIZED (SELECT max(i) AS i FROM {p}_h)"]
    for j in range(k, 0, -1):
        ctes.append(f"{p}_b{k}_{j - 1} AS MATERIALIZED (SELECT r.l AS i FROM {p}_d{j} WHERE i = (SELECT i FROM {p}_b{k}_{j}))")
    mean = [f"(SELECT (b.s - a.s) / (b.w - a.w) FROM {p}_h a, {p}_h b WHERE a.i = (SELECT i FROM {p}_b{k}_{j}) "
            f"AND b.i = (SELECT i FROM {p}_b{k}_{j + 1})) + m AS c{j}" for j in range(k)]
    ctes.append(f"{p}_c{k} AS MATERIALIZED (SELECT {', '.join(mean)} FROM "
                f"(SELECT round(sum(weight * value) / sum(weight)) AS m FROM {hist}))")
    return ctes, f"{p}_c{k}"


def assign_case(x: str, c: str, k: int) -> str:
    if k == 1:
        return "0"
    return ("CASE " + " ".join(f"WHEN {x} <= ({c}.c{i} + {c}.c{i + 1}) / 2.0 THEN {i}"
                               for i in range(k - 1)) + f" ELSE {k - 1} END")


def ranked_clusters_ctes(p: str, hist: str, k: int) -> tuple[list[str], str, str]:
    """Best clustering + the rank map ``{p}_rank(cl, rank)`` by weighted cluster mean."""
    centres, final = centre_ctes(p, hist, k)
    ctes = best_ctes(p, hist, k) + centres
    ctes.append(f"{p}_rank AS MATERIALIZED (SELECT cl, CAST(row_number() OVER (ORDER BY m, cl) - 1 "
                f"AS INTEGER) AS rank FROM (SELECT {assign_case('h.value', 'c', k)} AS cl, "
                f"sum(h.weight * h.value) / sum(h.weight) AS m FROM {hist} h, {final} c GROUP BY 1))")
    return ctes, final, f"{p}_rank"


def _rfm_ctes() -> str:
    parts = [MEASURES]
    joins, cols = [], []
    for m, k in (("recency", 4), ("frequency", 4), ("revenue", 3)):
        parts.append(f"h_{m} AS MATERIALIZED (SELECT CAST({m} AS DOUBLE) AS value, "
                     f"CAST(sum(rows) AS DOUBLE) AS weight FROM per GROUP BY 1)")
        ctes, final, rank = ranked_clusters_ctes(f"k_{m}", f"h_{m}", k)
        parts += ctes
        joins.append(f"CROSS JOIN {final} AS f_{m}")
        cols.append((m, k, final, rank))
    lab = ", ".join(f"{assign_case(f'CAST(per.{m} AS DOUBLE)', f'f_{m}', k)} AS cl_{m}"
                    for m, k, _, _ in cols)
    parts.append(f"labelled AS (SELECT per.*, {lab} FROM per {' '.join(joins)})")
    rank_joins = " ".join(f"JOIN k_{m}_rank r_{m} ON r_{m}.cl = l.cl_{m}" for m, _, _, _ in cols)
    parts.append(f"""rfm0 AS (SELECT l.customer_unique_id, l.last_purchase, l.recency, l.frequency,
       l.revenue, l.rows, r_recency.rank AS recency_cluster, r_frequency.rank AS frequency_cluster,
       r_revenue.rank AS revenue_cluster FROM labelled l {rank_joins})""")
    parts.append("""rfm AS MATERIALIZED (SELECT *, recency_cluster + frequency_cluster + revenue_cluster
       AS overall_score,
       CASE WHEN recency_cluster + frequency_cluster + revenue_cluster > 3 THEN 'high_value'
            WHEN recency_cluster + frequency_cluster + revenue_cluster > 1 THEN 'mid_value'
            ELSE 'low_value' END AS category FROM rfm0)""")
    return ",\n".join(parts)


RFM = _rfm_ctes()

register("rfm_clusters", with_fact("""
SELECT customer_unique_id, recency, recency_cluster, frequency, frequency_cluster,
       round(revenue, 2) AS revenue, revenue_cluster, overall_score, category FROM rfm""",
                                   extra=RFM))

register("rfm_score_means", with_fact("""
SELECT overall_score, round(sum(recency * rows) / sum(rows), 4) AS recency,
       round(sum(frequency * rows) / sum(rows), 4) AS frequency,
       round(sum(revenue * rows) / sum(rows), 4) AS revenue
FROM rfm GROUP BY 1""", extra=RFM))

register("rfm_categories", with_fact("""
SELECT category, count(*) AS customers, CAST(sum(rows) AS BIGINT) AS rows FROM rfm GROUP BY 1""", extra=RFM))

register("rfm_scatter_points", with_fact("""
SELECT category, frequency AS x, round(revenue, 2) AS y, CAST(sum(rows) AS BIGINT) AS n FROM rfm
WHERE revenue < 4000000 AND frequency < 7000 GROUP BY 1, 2, 3""", extra=RFM))

register("rfm_scatter_recency", with_fact("\nUNION ALL\n".join(f"""
SELECT '{y}' AS y_measure, category, recency AS x, round(CAST({y} AS DOUBLE), 2) AS y,
       CAST(sum(rows) AS BIGINT) AS n
FROM rfm WHERE revenue < 4000000 AND frequency < 7000 GROUP BY category, recency, {y}"""
    for y in ("revenue", "frequency")), extra=RFM))


def _window_sql(start: str, end_next: str, with_clv: bool) -> str:
    clv_col = ", round(r.revenue, 2) AS CLV" if with_clv else ""
    clv_grp = ", 10" if with_clv else ""
    return f"""
SELECT r.customer_unique_id, r.recency, r.recency_cluster, r.frequency, r.frequency_cluster,
       round(r.revenue, 2) AS revenue, r.revenue_cluster, r.overall_score, r.category{clv_col},
       count(*) AS rows
FROM clv c JOIN rfm r USING (customer_unique_id)
WHERE c.order_purchase_timestamp >= TIMESTAMP '{start}' AND c.order_purchase_timestamp < TIMESTAMP '{end_next}'
GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9{clv_grp}"""


register("window_short", with_fact(_window_sql("1996-10-01", "1997-06-02", False), extra=RFM))
register("window_long", with_fact(_window_sql("1996-07-01", "1998-08-02", True), extra=RFM))

VALUE = RFM + """,
wrows AS (SELECT customer_unique_id, count(*) AS n FROM clv
          WHERE order_purchase_timestamp >= TIMESTAMP '1996-07-01'
            AND order_purchase_timestamp < TIMESTAMP '1998-08-02'
            AND customer_unique_id IS NOT NULL GROUP BY 1),
val AS MATERIALIZED (SELECT r.*, coalesce(r.revenue * w.n, 0.0) AS m14_revenue
                     FROM rfm r LEFT JOIN wrows w USING (customer_unique_id)),
p99 AS (SELECT quantile_cont(v.m14_revenue, 0.99) AS q
        FROM clv c JOIN val v USING (customer_unique_id)),
trimmed AS MATERIALIZED (SELECT * FROM val WHERE m14_revenue < (SELECT q FROM p99))"""


def _value_ctes() -> str:
    parts = [VALUE, "h_clv AS MATERIALIZED (SELECT m14_revenue AS value, CAST(sum(rows) AS DOUBLE) "
                    "AS weight FROM trimmed GROUP BY 1)"]
    ctes, final, rank = ranked_clusters_ctes("k_clv", "h_clv", 3)
    parts += ctes
    parts.append(f"""valued AS MATERIALIZED (SELECT t.*, r.rank AS CLV_cluster FROM trimmed t
       CROSS JOIN {final} f JOIN {rank} r ON r.cl = {assign_case('t.m14_revenue', 'f', 3)})""")
    return ",\n".join(parts)


VALUED = _value_ctes()

register("clv_window_value", with_fact("""
SELECT customer_unique_id, round(m14_revenue, 2) AS m14_revenue, rows FROM trimmed""",
                                       extra=VALUE))

register("clv_clusters", with_fact("""
SELECT CLV_cluster, count(*) AS customers, CAST(sum(rows) AS BIGINT) AS rows,
       round(sum(m14_revenue * rows) / sum(rows), 2) AS mean, round(min(m14_revenue), 2) AS min,
       round(max(m14_revenue), 2) AS max
FROM valued GROUP BY 1""", extra=VALUED))

register("clv_describe", with_fact("""
SELECT CLV_cluster, count(*) AS count, round(avg(m14_revenue), 2) AS mean,
       round(stddev_samp(m14_revenue), 2) AS std, round(min(m14_revenue), 2) AS min,
       round(quantile_cont(m14_revenue, 0.25), 2) AS p25, round(quantile_cont(m14_revenue, 0.5), 2) AS p50,
       round(quantile_cont(m14_revenue, 0.75), 2) AS p75, round(max(m14_revenue), 2) AS max
FROM clv JOIN valued USING (customer_unique_id) GROUP BY 1""", extra=VALUED))

register("clv_score_points", with_fact("""
SELECT category, overall_score AS x, round(m14_revenue, 2) AS y, CAST(sum(rows) AS BIGINT) AS n
FROM valued WHERE m14_revenue < 4000000 GROUP BY 1, 2, 3""", extra=VALUED))

register("clv_one_hot", with_fact("""
SELECT customer_unique_id, overall_score, round(m14_revenue, 2) AS m14_revenue, CLV_cluster, rows,
       CAST(category = 'high_value' AS INTEGER) AS category_high_value,
       CAST(category = 'low_value' AS INTEGER) AS category_low_value,
       CAST(category = 'mid_value' AS INTEGER) AS category_mid_value
FROM valued""", extra=VALUED))

_CLV_FEATURES = ("payment_value", "price", "recency", "recency_cluster", "frequency",
                 "frequency_cluster", "revenue", "revenue_cluster", "overall_score",
                 "m14_revenue", "CLV_cluster")


def _target_pairs_sql(src: str, target: str, feats) -> str:
    aggs, rows = [], []
    for i, a in enumerate(feats):
        cond = f"FILTER (WHERE {a} IS NOT NULL AND {target} IS NOT NULL)"
        aggs.append(f"covar_pop({a}, {target}) {cond} AS cov{i}, stddev_pop({a}) {cond} AS sa{i}, "
                    f"stddev_pop({target}) {cond} AS sb{i}")
        rows.append(f"SELECT '{a}' AS feature, round(cov{i} / nullif(sa{i} * sb{i}, 0), 6) AS corr FROM tm")
    return (f"tm AS MATERIALIZED (SELECT " + ",\n  ".join(aggs) + f" FROM {src})", "\nUNION ALL\n".join(rows))


_tm, _tq = _target_pairs_sql("crows", "CLV_cluster", _CLV_FEATURES)
register("clv_target_corr", with_fact(_tq, extra=VALUED + """,
crows AS MATERIALIZED (SELECT c.payment_value, c.price, v.recency, v.recency_cluster, v.frequency,
       v.frequency_cluster, v.revenue, v.revenue_cluster, v.overall_score, v.m14_revenue,
       v.CLV_cluster FROM clv c JOIN valued v USING (customer_unique_id)),
""" + _tm))

# --- scalar functions ---------------------------------------------------------------------

register("text_number_casts", """
SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
       TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN '1' ELSE o_orderstatus END AS INTEGER) AS status_num,
       count(*) AS n
FROM (SELECT strptime(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts,
             o_orderstatus FROM orders)
GROUP BY 1, 2, 3""")

register("bucketed_order_join", """
SELECT o_orderpriority AS order_priority, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS lines,
       count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")

# --- models -------------------------------------------------------------------------------

_X = ("payment_value", "freight_value", "product_weight_g")


def _det3(m) -> str:
    return (f"(({m[0][0]}) * (({m[1][1]}) * ({m[2][2]}) - ({m[1][2]}) * ({m[2][1]}))"
            f" - ({m[0][1]}) * (({m[1][0]}) * ({m[2][2]}) - ({m[1][2]}) * ({m[2][0]}))"
            f" + ({m[0][2]}) * (({m[1][0]}) * ({m[2][1]}) - ({m[1][1]}) * ({m[2][0]})))")


def _ols_ctes() -> str:
    a = [[f"a{i}{j}" for j in range(3)] for i in range(3)]
    b = [f"b{i}" for i in range(3)]
    aggs = [f"covar_pop({_X[i]}, {_X[j]}) AS a{i}{j}" for i in range(3) for j in range(3)]
    aggs += [f"covar_pop({_X[i]}, price) AS b{i}" for i in range(3)]
    aggs += [f"avg({x}) AS m{i}" for i, x in enumerate(_X)] + ["avg(price) AS my"]
    det = _det3(a)
    betas = []
    for k in range(3):
        mk = [[(b[i] if j == k else a[i][j]) for j in range(3)] for i in range(3)]
        betas.append(f"{_det3(mk)} / {det} AS beta{k}")
    return f"""split AS (SELECT {ROW_KEYS}, payment_value, freight_value, product_weight_g, price,
       CASE WHEN {bucket()} < 20 THEN 'test' ELSE 'train' END AS split FROM fact),
mom AS MATERIALIZED (SELECT {', '.join(aggs)} FROM split WHERE split = 'train'),
ols AS MATERIALIZED (SELECT {', '.join(betas)}, * FROM mom),
coef AS MATERIALIZED (SELECT beta0, beta1, beta2, my - (beta0 * m0 + beta1 * m1 + beta2 * m2) AS intercept FROM ols),
pred AS (SELECT s.*, (c.beta0 * s.payment_value + c.beta1 * s.freight_value
                      + c.beta2 * s.product_weight_g) + c.intercept AS prediction
         FROM split s, coef c)"""


OLS = _ols_ctes()

register("price_linear_coefficients", with_fact("""
SELECT 'intercept' AS term, round(intercept, 4) AS value FROM coef
UNION ALL SELECT 'payment_value', round(beta0, 4) FROM coef
UNION ALL SELECT 'freight_value', round(beta1, 4) FROM coef
UNION ALL SELECT 'product_weight_g', round(beta2, 4) FROM coef""", extra=OLS))

register("price_linear_metrics", with_fact("""
SELECT split, round(1 - sum((price - prediction) ^ 2) / (var_pop(price) * count(price)), 4) AS r2,
       round(avg((price - prediction) ^ 2), 0) AS mse, count(*) AS n
FROM pred GROUP BY 1""", extra=OLS))

register("price_linear_predictions", with_fact("""
SELECT round(pred_price, 4) AS pred_price, round(price, 4) AS price,
       round(difference, 4) AS difference, round(pct_error, 4) AS pct_error FROM (
  SELECT DISTINCT pred_price, price, price - pred_price AS difference,
         100.0 * abs(price - pred_price) / nullif(price, 0) AS pct_error
  FROM (SELECT round_even(prediction, 2) AS pred_price, price FROM pred))
ORDER BY price, pred_price LIMIT 100""", extra=OLS))



def _boost_ctes(trees: int = 3, depth: int = 3, step: str = "0.3") -> str:
    """Boosted trees level by level: histograms of residual sums, best split of each node, new nodes."""
    quantiles = ", ".join(f"{i} / 32.0" for i in range(1, 32))
    edges = ", ".join(f"list_sort(list_distinct(quantile_cont(CAST({x} AS DOUBLE), [{quantiles}]))) AS e{i}" for i, x in enumerate(_X))
    bins = ", ".join(f"len(list_filter(e{i}, lambda e: e < {x})) AS b{i}" for i, x in enumerate(_X))
    out = [OLS, f"edges AS MATERIALIZED (SELECT {edges} FROM split WHERE split = 'train')",
           f"cells AS MATERIALIZED (SELECT split, b0, b1, b2, count(*) AS n, avg(price) AS mean, var_pop(price) * count(*) AS ss "
           f"FROM (SELECT split, price, {bins} FROM split, edges) GROUP BY ALL)",
           "base AS MATERIALIZED (SELECT sum(n * mean) / sum(n) AS base, sum(n * mean * mean) AS scale FROM cells WHERE split = 'train')",
           "s1_0 AS MATERIALIZED (SELECT cells.*, base AS pred, 1 AS node, CAST(0 AS DOUBLE) AS val FROM cells, base)"]
    for t in range(1, trees + 1):
        for level in range(depth):
            s, b = f"s{t}_{level}", f"best{t}_{level}"
            hist = " UNION ALL ".join(f"SELECT node, {i} AS f, b{i} AS b, sum(n) AS n, sum(n * (mean - pred)) AS g FROM {s} WHERE split = 'train' GROUP BY ALL"
                                      for i in range(3))
            out.append(f"""{b} AS MATERIALIZED (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) AS rn FROM (
    SELECT *, round((gl * gl / nl + (g - gl) * (g - gl) / (n - nl) - g * g / n) / (SELECT scale FROM base), 10) AS gain,
           gl / nl AS lv, (g - gl) / (n - nl) AS rv FROM (
      SELECT node, f, b, sum(n) OVER (PARTITION BY node, f ORDER BY b) AS nl, sum(g) OVER (PARTITION BY node, f ORDER BY b) AS gl,
             sum(n) OVER (PARTITION BY node, f) AS n, sum(g) OVER (PARTITION BY node, f) AS g FROM ({hist}))
    WHERE nl < n) WHERE gain > 0) WHERE rn = 1)""")
            goes_left = "CASE w.f WHEN 0 THEN s.b0 WHEN 1 THEN s.b1 ELSE s.b2 END <= w.b"
            after = f"""SELECT s.split, s.b0, s.b1, s.b2, s.n, s.mean, s.ss, s.pred,
       CASE WHEN w.node IS NULL THEN s.node WHEN {goes_left} THEN 2 * s.node ELSE 2 * s.node + 1 END AS node,
       CASE WHEN w.node IS NULL THEN s.val WHEN {goes_left} THEN w.lv ELSE w.rv END AS val
       FROM {s} s LEFT JOIN {b} w ON w.node = s.node"""
            if level + 1 < depth:
                out.append(f"s{t}_{level + 1} AS MATERIALIZED ({after})")
            else:
                out.append(f"s{t + 1}_0 AS MATERIALIZED (SELECT split, b0, b1, b2, n, mean, ss, pred + {step} * val AS pred, 1 AS node, "
                           f"CAST(0 AS DOUBLE) AS val FROM ({after}))")
    return ",\n".join(out)


BOOSTED = _boost_ctes()

register("price_boost_splits", with_fact(" UNION ALL ".join(f"""
SELECT CAST({t} AS INTEGER) AS tree, CAST(w.node AS INTEGER) AS node,
       CASE w.f WHEN 0 THEN '{_X[0]}' WHEN 1 THEN '{_X[1]}' ELSE '{_X[2]}' END AS feature,
       round(CASE w.f WHEN 0 THEN e0[w.b + 1] WHEN 1 THEN e1[w.b + 1] ELSE e2[w.b + 1] END, 4) AS threshold,
       CAST(w.n AS BIGINT) AS rows, round(w.gain, 4) AS gain, round(w.lv, 4) AS left_value, round(w.rv, 4) AS right_value
FROM best{t}_{level} w, edges""" for t in range(1, 4) for level in range(3)), extra=BOOSTED))

register("price_boost_metrics", with_fact("""
SELECT split, round(1 - sse / nullif(sst, 0), 6) AS r2, round(sse / n, 0) AS mse, n FROM (
  SELECT split, sum(ss + n * (mean - pred) ^ 2) AS sse, sum(ss) + sum(n * mean ^ 2) - sum(n * mean) ^ 2 / sum(n) AS sst,
         CAST(sum(n) AS BIGINT) AS n FROM s4_0 GROUP BY split)""", extra=BOOSTED))

CLASSIFIED = VALUED + f""",
crow AS MATERIALIZED (SELECT c.{ROW_KEYS.replace(', ', ', c.')}, v.category, v.CLV_cluster,
       CASE WHEN {bucket('c.' + ROW_KEYS.replace(', ', ', c.'), salt='56')} < 25 THEN 'test' ELSE 'train' END AS split
       FROM clv c JOIN valued v USING (customer_unique_id)),
majority AS (SELECT category, CLV_cluster AS prediction FROM (
       SELECT category, CLV_cluster, row_number() OVER (PARTITION BY category
              ORDER BY count(*) DESC, CLV_cluster) AS rn
       FROM crow WHERE split = 'train' GROUP BY 1, 2) WHERE rn = 1),
predicted AS (SELECT c.*, m.prediction FROM crow c JOIN majority m USING (category)),
conf AS (SELECT CAST(CLV_cluster AS INTEGER) AS label, CAST(prediction AS INTEGER) AS prediction,
       count(*) AS n FROM predicted WHERE split = 'test' GROUP BY 1, 2)"""

register("value_classifier_confusion", with_fact("SELECT * FROM conf", extra=CLASSIFIED))

register("value_classifier_metrics", with_fact("""
SELECT class, tp, fp, fn, tn, round(recall, 4) AS recall, round(precision, 4) AS precision,
       round(5.0 * precision * recall / nullif(4.0 * precision + recall, 0), 4) AS f_beta,
       round(5.0 * precision * recall / nullif(5.0 * precision + recall, 0), 4) AS f_beta_alt
FROM (
  SELECT cls AS class, tp, predicted - tp AS fp, actual - tp AS fn,
         total - actual - predicted + tp AS tn,
         tp / nullif(actual, 0) AS recall, tp / nullif(predicted, 0) AS precision
  FROM (
    SELECT k.cls, coalesce(a.n, 0) AS actual, coalesce(p.n, 0) AS predicted,
           coalesce(t.n, 0) AS tp, (SELECT CAST(sum(n) AS BIGINT) FROM conf) AS total
    FROM (SELECT label AS cls FROM conf UNION SELECT prediction FROM conf) k
    LEFT JOIN (SELECT label AS cls, CAST(sum(n) AS BIGINT) AS n FROM conf GROUP BY 1) a USING (cls)
    LEFT JOIN (SELECT prediction AS cls, CAST(sum(n) AS BIGINT) AS n FROM conf GROUP BY 1) p USING (cls)
    LEFT JOIN (SELECT label AS cls, n FROM conf WHERE label = prediction) t USING (cls)))""",
                                               extra=CLASSIFIED))

register("value_classifier_accuracy", with_fact("""
SELECT split, round(avg(CASE WHEN CLV_cluster = prediction THEN 1.0 ELSE 0.0 END), 4) AS accuracy,
       count(*) AS n FROM predicted GROUP BY 1""", extra=CLASSIFIED))


def _elbow_sql(measure: str, most: int = 7, digits: int = 0) -> str:
    parts = [MEASURES, f"h_rec AS MATERIALIZED (SELECT CAST({measure} AS DOUBLE) AS value, "
                       "CAST(sum(rows) AS DOUBLE) AS weight FROM per GROUP BY 1)", *best_ctes("e", "h_rec", most)]
    sse = []
    for k in range(1, most + 1):
        ctes, final = centre_ctes("e", "h_rec", k)
        parts += ctes
        centre = ("c.c0" if k == 1 else
                  "CASE " + " ".join(f"WHEN {assign_case('h.value', 'c', k)} = {i} THEN c.c{i}"
                                     for i in range(k)) + " END")
        sse.append(f"SELECT {k} AS k, round(sum(h.weight * (h.value - {centre}) ^ 2), {digits}) AS sse "
                   f"FROM h_rec h, {final} c")
    return with_fact("\nUNION ALL\n".join(sse), extra=",\n".join(parts))


register("elbow_curve", _elbow_sql("recency"))
register("elbow_frequency", _elbow_sql("frequency"))
register("elbow_revenue", _elbow_sql("revenue", digits=-6))


# --- the two studies end to end -----------------------------------------------------------

def _steps(*steps: tuple[str, str, str, dict[str, str]]) -> str:
    """(step, query, item expression, name of value -> expression) as (step, item, value) rows."""
    out = []
    for step, sql, item, values in steps:
        for name, value in values.items():
            key = f"{item} || '.{name}'" if name else item
            out.append(f"SELECT '{step}' AS step, {key} AS item, CAST({value} AS DOUBLE) AS value FROM ({sql})")
    return "\nUNION ALL\n".join(out)


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


register("price_study", _steps(
    ("pairs", SQL["corr_pairs"], "col_a || '|' || col_b", {"": "corr"}), ("target", SQL["target_corr"], "feature", {"": "corr"}),
    ("importance", SQL["tree_importance_exact"], "feature", {"": "importance"}),
    ("components", SQL["explained_variance"], "CAST(component AS VARCHAR)", {"": "cum_pct"}),
    ("linear", SQL["price_linear_metrics"], "split", _same("r2", "mse", "n"))))

_indicators = "\nUNION ALL\n".join(
    f"SELECT 'category_{c}' AS feature, round(covar_pop(x, CLV_cluster) / nullif(stddev_pop(x) * stddev_pop(CLV_cluster), 0), 6) AS corr "
    f"FROM (SELECT CASE WHEN v.category = '{c}' THEN 1 ELSE 0 END AS x, v.CLV_cluster FROM clv c JOIN valued v USING (customer_unique_id))"
    for c in ("high_value", "low_value", "mid_value"))
register("clv_study", _steps(
    ("spread", SQL["measure_describe"], "measure", _same("mean", "std", "p50", "max")),
    ("score_means", SQL["rfm_score_means"], "CAST(overall_score AS VARCHAR)", _same("recency", "frequency", "revenue")),
    ("categories", SQL["rfm_categories"], "category", {"": "customers"}),
    ("value_clusters", SQL["clv_clusters"], "CAST(CLV_cluster AS VARCHAR)", {"customers": "customers", "most": "max"}),
    ("correlations", SQL["clv_target_corr"], "feature", {"": "corr"}),
    ("correlations", with_fact(_indicators, extra=VALUED), "feature", {"": "corr"}),
    ("classifier", SQL["value_classifier_metrics"], "CAST(class AS VARCHAR)", _same("f_beta", "tp"))))
