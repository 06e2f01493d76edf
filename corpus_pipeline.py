"""From documents to token files: language ID, near duplicates, decontamination, mixing, tokens.

Every stage is written as Parquet and read again as the next one's documents, so a lost executor
costs no more than the stage at work. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm import decontaminate, language, mixing, simhash, token_files
from reviewlake.llm.queries import TOKENIZER, Query
from reviewlake.llm.tables import fresh_folder, held_out, read, stage

MEMO_PIECES = 400_000  # workers hold memory of earlier stages too

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    return language.identified(docs, language.train(docs.where(~held_out("doc_id"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    return simhash.keep_one(docs)


def benchmark_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and (doc_id, start, n_tokens, ids_crc32) read back from them."""
    path = fresh_folder(spark, "tokens")
    token_files.write_tokens(docs, path, TOKENIZER, memo=MEMO_PIECES)
    return token_files.token_index(spark, path, release=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_clean", benchmark_clean),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs


QUERY = Query(run, ORACLE_SQL)
