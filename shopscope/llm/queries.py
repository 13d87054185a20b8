"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopscope.llm import (fingerprints, jaccard, leaks, licenses, mixing, packing, periods, pii, quality, ranking, suffixes, tokens,
                           toxicity)
from shopscope.llm.common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(documents(spark, sf_dir)).drop("kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(documents(spark, sf_dir), links=True)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = tokens.write_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_tokens(spark, folder)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), _labels(spark, sf_dir)) \
        .withColumn("quality", F.round("quality", 9))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(documents(spark, sf_dir), _benchmark(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    runs = periods.periodic_runs(documents(spark, sf_dir), F.when(h % 10 == 0, F.floor(h / 10)))
    best = periods.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return runs.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = leaks.benchmark_hits(documents(spark, sf_dir), _benchmark(spark, sf_dir))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_suffix_dedup, op3_toxicity, op4_ngram_jaccard, op5_pii, op6_best_fit_packing,
                            op7_source_mixing, op8_token_output, op9_quality_rules, op10_fingerprints,
                            op11_ranked_search, op12_periodic_runs, op13_decontamination)}

#: DuckDB SQL of the operators that SQL expresses.
SQL: dict[str, str] = {"op7_source_mixing": mixing.MIXTURE_SQL, "op11_ranked_search": ranking.RANKED_SQL,
                       "op13_decontamination": leaks.LEAKS_SQL}
