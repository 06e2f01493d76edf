"""The registered queries of this folder, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations,
    decontaminate,
    exact_dedup,
    hard_negatives,
    language,
    main_text,
    mixing,
    quality,
    repeats,
    simhash,
    token_files,
    toxicity,
    warc,
)
from .tables import fresh_folder, held_out, read

Run = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


class Query(NamedTuple):
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = Query(run, sql)
        return run

    return register


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                         "component_id")


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "tokens")
    token_files.write_tokens(read(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_files.token_index(spark, path)


@query("op10_decontaminate", decontaminate.leaks_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op4_mix_sources")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.train(docs.where(~held_out("doc_id")))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(~held_out("doc_id"))
    learned = toxicity.learn(docs, labels)
    return toxicity.score(docs, learned).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


@query("op2_main_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(read(spark, sf_dir, "pages"))


@query("op3_warc", warc.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write_archives(read(spark, sf_dir, "pages"), folder)
    return warc.read_records(index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_repeats")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


@query("op12_exact_dedup", exact_dedup.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.equal_groups(read(spark, sf_dir, "documents"))


@query("op11_hard_negatives", hard_negatives.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = read(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query("op13_collocations", collocations.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))
