"""Queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard_join, langid, licences, main_text, mixing, periodic_runs, quality_fm, quality_rules, spelling, token_ids, toxicity, warc
from .common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_quality_fm(spark, sf_dir):
    return quality_fm.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_licence_scan(spark, sf_dir):
    return licences.licence_scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc_archive(spark, sf_dir):
    path = new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path)


def op7_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_ids(spark, sf_dir):
    path = new_path(spark, "token-ids")
    token_ids.write_ids(table(spark, sf_dir, "documents"), path)
    return token_ids.read_ids(spark, path, with_ids=False)


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op10_language_id(spark, sf_dir):
    return langid.languages(table(spark, sf_dir, "documents"))


def op11_main_text(spark, sf_dir):
    return main_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"))


def base_quality_statistics(spark, sf_dir):
    """What of op2 SQL can express."""
    return op2_quality_rules(spark, sf_dir).drop("kept")


def base_licence_places(spark, sf_dir):
    """What of op4 SQL can express."""
    return op4_licence_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES = [op1_mix_sources, op2_quality_rules, op3_quality_fm, op4_licence_scan, op5_toxicity, op6_warc_archive, op7_decontaminate, op8_token_ids, op9_jaccard_join, op10_language_id, op11_main_text, op12_spelling_variants, op13_periodic_runs, base_quality_statistics, base_licence_places]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
