"""Queries over the text, vector and page tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import alignment, bpe, centroids, html, langid, lattice, line_dedup, mixing, packing, planes, quality_lines, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op2_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op4_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.line_frequency_rules(table(spark, sf_dir, "documents"))


def op6_byte_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)


def op9_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op10_general_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_elementary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_exact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_template_removal": op1_template_removal,
    "op2_counterfactual": op2_counterfactual,
    "op3_line_spread": op3_line_spread,
    "op4_e8_lattice": op4_e8_lattice,
    "op5_line_frequency": op5_line_frequency,
    "op6_byte_planes": op6_byte_planes,
    "op7_fair_queue": op7_fair_queue,
    "op8_rank_array_bpe": op8_rank_array_bpe,
    "op9_hyperdimensional": op9_hyperdimensional,
    "op10_general_pigeonhole": op10_general_pigeonhole,
    "op11_linear_grouping": op11_linear_grouping,
    "op12_elementary_intervals": op12_elementary_intervals,
    "op13_exact_clusters": op13_exact_clusters,
}
SQL: dict[str, str] = {
    "op3_line_spread": line_dedup.LINES_SQL,
    "op4_e8_lattice": lattice.VECTORS_SQL,
    "op5_line_frequency": quality_lines.RULES_SQL,
    "op7_fair_queue": mixing.MIX_SQL,
    "op13_exact_clusters": centroids.CLUSTERS_SQL,
}
