"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets.

Sources, ordered by code point with null last, weigh 1, 2, 3, repeating. Together they are to take as
many words as there are; no source takes more than ``MAX_EPOCHS`` times its own size, and the excess
goes to the others by weight (the level that settles this follows from one running sum over the
sources, ordered by cap / weight). A source's budget is first spent on complete epochs. What is left
selects documents by ascending key -ln(u) / w: u from the MD5 of seed and doc_id (equal on every
run), w the document's quality weight (1 minus its symbols for each word, at least 0.1), sorted and
prefix-summed within the source; the document that reaches the budget counts up to it.

A source isn't sorted in one task: keys are cut into ``SLICES`` ranges, sums of the slices give each slice's
start, and only a slice is sorted at a time. The ranges are equal shares of the mean distribution of keys over the
quality weights ``RATES``; whatever the qualities of a source, about 1/200 of its rows at most share a slice.

The documents of a mix aren't sorted or exchanged at all: each source's last key that is within its budget comes from
sizes alone, and every document is held against its source's.

Null text: size 0, takes 0. Empty input: empty result. Repeated rows take part one by one; between
rows with the same key the order is by text. A null source is a source of its own; a source without
words has target 0. Null ids share one key and are ordered by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopscope.llm.common import WORD_PATTERN, passing_tables, ship_package, staged

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
SLICES = 1024
MIN_QUALITY = 0.1
#: Quality weights between which every document's weight lies.
RATES = (0.1, 0.18, 0.32, 0.56, 1.0)


def _measured(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        # a source's name, or nothing, as a key that is never null
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("skey"),
        size.alias("size"), symbols.alias("symbols"), F.xxhash64(text).alias("tie"),
        ((h.cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))).alias("u"), *more)
    quality = F.greatest(F.lit(MIN_QUALITY), 1 - F.col("symbols") / F.greatest("size", F.lit(1)))
    rows = rows.withColumn("key", -F.log("u") / quality)
    share = sum((1 - F.exp(F.col("key") * -r) for r in RATES), F.lit(0.0)) / len(RATES)
    return rows.withColumn("slice", F.least(F.lit(SLICES - 1), F.floor(share * SLICES)).cast("int")).drop("symbols", "u")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(skey, source_size, target, epochs, rest) from one row (skey, source, source_size) for each source."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]),
                                                ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)))
    w = w.withColumns({"cap": MAX_EPOCHS * F.col("source_size"), "total": F.sum("source_size").over(every),
                       "weights": F.sum("weight").over(every)})
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"capped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
                       "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    level = (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("gone"))
    w = w.withColumn("level", F.min(F.when(level <= F.col("ratio"), F.struct(F.col("ratio"), level.alias("value")))).over(every)["value"])
    w = w.withColumn("target", F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double")))
    budget = F.floor(F.col("target") + 0.5)
    w = w.withColumn("epochs", F.coalesce(F.floor(budget / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
    return w.select("skey", "source_size", "target", "epochs", (budget - F.col("epochs") * F.col("source_size")).alias("rest"))


def _sliced(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(every row's size and key; of each slice its words, the words before it and its source's target; the targets)."""
    ship_package(docs.sparkSession)
    rows = staged(_measured(docs), "mix-sizes")
    slices = rows.groupBy("skey", "slice").agg(F.min("source").alias("source"), F.sum("size").alias("words"))
    slices = staged(slices, "mix-slices")
    targets = source_targets(slices.groupBy("skey").agg(F.min("source").alias("source"), F.sum("words").alias("source_size")))
    ahead = Window.partitionBy("skey").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begin = slices.select("skey", "slice", "words", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("begin"))
    return rows, begin.join(targets, "skey"), targets


def _selected(docs: DataFrame) -> DataFrame:
    """Every row with its source's target, its epochs and the words that the fractional selection takes."""
    rows, slices, _ = _sliced(docs)
    running = Window.partitionBy("skey", "slice").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(slices, ["skey", "slice"]).withColumn("before", F.col("begin") + F.sum("size").over(running) - F.col("size"))
    return out.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before"))))


def _borders(docs: DataFrame) -> DataFrame:
    """(skey, epochs, last, whole): one row for each source; its fraction takes the rows before ``last``, and
    those at ``last`` if ``whole``. ``last`` is null where no fraction is left."""
    rows, slices, targets = _sliced(docs)
    # the slice in which the budget ends
    at = slices.where((F.col("begin") < F.col("rest")) & (F.col("rest") <= F.col("begin") + F.col("words")))
    equal = rows.join(at.drop("words", "source_size", "target", "epochs"), ["skey", "slice"]) \
        .groupBy("skey", "begin", "rest", _place().alias("last")).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("skey").orderBy("last").rowsBetween(Window.unboundedPreceding, 0)
    equal = equal.withColumn("before", F.col("begin") + F.sum("words").over(running) - F.col("words"))
    left = F.col("rest") - F.col("before")
    last = equal.where((left > 0) & (left <= F.col("words"))).select("skey", "last", (2 * left >= F.col("words")).alias("whole"))
    return targets.select("skey", "epochs").join(last, "skey", "left")


def _place() -> Column:
    """A row's place in the order of its source; rows that are equal there are the same document repeated."""
    return F.struct(F.col("key"), F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("tie"))


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of every document."""
    return _selected(docs).select("doc_id", "size", "source_size", "target",
                                  (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"), "source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the input's own columns.

    Texts stay whole: the document that reaches the budget is taken if at least half of it is within. Rows of that
    document that are repeated (same id, text and source) are taken together, by the same rule on all their words."""
    with passing_tables(docs.sparkSession):
        # one row for each source, written: its size is known when the join is planned
        borders = staged(_borders(docs), "mix-borders", keep=True)
    given = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("given")
    out = _measured(docs, given).withColumn("place", _place()).join(borders, "skey")
    within = (F.col("place") < F.col("last")) | ((F.col("place") == F.col("last")) & F.col("whole"))
    out = out.withColumn("copies", (F.col("epochs") + F.when((F.col("size") > 0) & within, 1).otherwise(0)).cast("int"))
    return out.where("copies > 0").select("given", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("given.*")


#: DuckDB's view of ``mixture``.
MIXTURE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '{WORD_PATTERN}'))::BIGINT AS size,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS symbols,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u
  FROM d
), k AS (
  SELECT *, -ln(u) / greatest({MIN_QUALITY}::DOUBLE, 1 - symbols::DOUBLE / greatest(size, 1)) AS key FROM m
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
         3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s
), r AS (
  SELECT *, cap / weight AS ratio, sum(weight) OVER () AS weights FROM w
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER before, 0)::BIGINT)::DOUBLE / (weights - coalesce(sum(weight) OVER before, 0)) AS lev
  FROM r WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(weight * (SELECT arg_min(lev, ratio) FROM l WHERE lev <= ratio), cap::DOUBLE) AS target FROM l
), b AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t
), e AS (
  SELECT *, coalesce(budget // nullif(source_size, 0), 0) AS epochs FROM b
), x AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest, k.source,
         (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT - k.size AS ahead
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken, source
FROM x
"""
