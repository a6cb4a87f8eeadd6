"""The registered queries of this subpackage, one per operator."""

from __future__ import annotations

from quernstone.llm import (
    op01_quality_divergence,
    op02_toxicity,
    op03_decontamination,
    op04_html,
    op05_secrets,
    op06_sharding,
    op07_near_dedup,
    op08_token_counts,
    op09_licenses,
    op10_packing,
    oracles,
)
from quernstone.llm.common import spread, table


def op1_quality_divergence(spark, sf_dir):
    rows = op01_quality_divergence.quality(spread(table(spark, sf_dir, "documents")))
    return rows.drop("char_distance", "word_distance")


def op2_toxicity(spark, sf_dir):
    return op02_toxicity.toxicity(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op3_decontamination(spark, sf_dir):
    return op03_decontamination.contamination(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark, sf_dir):
    return op04_html.extract(spread(table(spark, sf_dir, "pages")))


def op5_secret_scan(spark, sf_dir):
    return op05_secrets.scan(spread(table(spark, sf_dir, "documents")))


def op6_sharding(spark, sf_dir):
    return op06_sharding.digest(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark, sf_dir):
    return op07_near_dedup.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op8_token_counts(spark, sf_dir):
    return op08_token_counts.token_counts(spread(table(spark, sf_dir, "documents")))


def op9_license_scan(spark, sf_dir):
    return op09_licenses.scan(spread(table(spark, sf_dir, "documents")))


def op10_best_fit_packing(spark, sf_dir):
    return op10_packing.pack_documents(spread(table(spark, sf_dir, "documents")))


QUERIES = (
    op1_quality_divergence,
    op2_toxicity,
    op3_decontamination,
    op4_html_extraction,
    op5_secret_scan,
    op6_sharding,
    op7_near_dedup,
    op8_token_counts,
    op9_license_scan,
    op10_best_fit_packing,
)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return oracles.oracle_sql()
