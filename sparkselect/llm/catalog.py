"""The queries of the text operators: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import benchmark_overlap, conversation_repair, cover_search, html_extract, lattice_lm, near_duplicates, packing, personal_data, plane_files, quality_rules, ranked_search, source_mixing, substring_dedup
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op5_quality_rules", quality_rules.OP5_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op5_frame(table(spark, sf_dir, "documents"))


@query("op8_minhash_near_dedup")
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.op8_frame(table(spark, sf_dir, "documents"))


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op1_frame(table(spark, sf_dir, "documents"))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op3_frame(table(spark, sf_dir, "documents"))


@query("op4_token_plane_files")
def op4_token_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_files.op4_frame(table(spark, sf_dir, "documents"))


@query("op9_source_mixing")
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.op9_frame(table(spark, sf_dir, "documents"))


@query("op7_lattice_likelihood")
def op7_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.op7_frame(table(spark, sf_dir, "documents"))


@query("op6_personal_data")
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.op6_frame(table(spark, sf_dir, "documents"))


@query("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op10_frame(table(spark, sf_dir, "pages"))


@query("op2_cover_tree_search", cover_search.OP2_SQL)
def op2_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_search.op2_frame(table(spark, sf_dir, "embeddings"))


@query("op11_benchmark_overlap", benchmark_overlap.OP11_SQL)
def op11_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_overlap.op11_frame(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_ranked_search", ranked_search.OP12_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.op12_frame(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_conversation_repair", conversation_repair.OP13_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.op13_frame(table(spark, sf_dir, "conversations"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
