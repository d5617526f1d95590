"""The corpus pipeline: quality rules, n-gram Jaccard join, benchmark decontamination, mixing, token-ID output.

Each stage gets all that its predecessor kept, as Parquet read again, and its decisions take effect. The last one returns
doc_id, start, n_tokens and ids_crc32 of every document of the token files that it wrote.

Stages go by rows. A null or empty text fails the quality rules. Rows that repeat a text, or nearly, are one group whatever
their ids, of which the one with the smallest id stays (null last); rows with one id and unlike texts stay both. A null id
is no reason to go; it comes first in the token files. Columns besides those of documents pass through all stages but the
last, whatever their names. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import decontaminate, jaccard_join, mixing, quality_rules, token_ids
from fleetlens.llm.common import new_path, scratch

#: Near duplicates: words of a shingle, and the least similarity in percent (op9 by itself has 3 and 90).
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = new_path(spark, "corpus")
    token_ids.write_ids(docs, path)
    return token_ids.read_ids(spark, path, with_ids=False)


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("token-id output", token_output),
]

#: Tokenizers and quantile sketches have no SQL form; tests/llm hold run() against its stages one by one, and each operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each over the Parquet that the one before wrote.

    A stage's intermediate tables go when its result is written; the last one's are the token files, and stay. Stages that
    are called by themselves give lazy results: what these need stays until the driver's process ends, or until the `scratch`
    that the caller has open is left.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{k}")
        with scratch(spark) if k < len(STAGES) - 1 else nullcontext():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
