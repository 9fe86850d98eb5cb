"""The operators on whole tables, as registered queries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm import checks, collocations, decontam, jaccard, packing, pii, quality, ranked_search, sharding, site_tree, token_counts, token_files, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op2_token_files(spark, sf_dir):
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)


def op3_quality_rules(spark, sf_dir):
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op4_ngram_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark, sf_dir):
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontam.digest(found)


def op8_html_extraction(spark, sf_dir):
    return site_tree.main_text(_table(spark, sf_dir, "pages"))


def op10_pii_field(spark, sf_dir):
    return pii.find(_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark, sf_dir):
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_collocations(spark, sf_dir):
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_url_filter(spark, sf_dir):
    return url_filter.judge(_table(spark, sf_dir, "pages"))


oracle_sql = checks.oracle_sql


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}
