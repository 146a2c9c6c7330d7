"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from txnsift.llm import decontaminate, langid, mixing, nearcopies, tokenfile
from txnsift.llm.common import load, prepare
from txnsift.llm.queries import tokenizer_file
from txnsift.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the corpus labels; those without letters or far from all profiles go."""
    prepare(spark)
    return langid.keep_identified(docs, langid.fit_profiles(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group of near copies (SimHash within two bits, or five-word Jaccard similarity of 0.8 or more)."""
    prepare(spark)
    return nearcopies.drop_near_copies(docs, distance=2)


def remove_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages of `benchmark` out of the texts; a document of which nothing is left goes."""
    return decontaminate.remove_benchmark(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, dealt to shards and shuffled within each."""
    prepare(spark)
    return mixing.mix_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus in token files, and what they hold of each document."""
    prepare(spark)
    return tokenfile.read_tokens(tokenfile.write_tokens(docs, tokenizer_file()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", remove_benchmark_text),
    ("source_mix", mix_sources),
    ("token_files", write_token_files),
]

#: SQL cannot express language profiles or near copies; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table `documents`."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
