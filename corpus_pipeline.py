"""Cleaning a corpus in stages: language, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes documents and returns documents, but the last returns a row of token figures for each. run() applies
them one after another, storing what each kept in the cluster's shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, decontaminate, langid, secrets, simhash
from kinweave.llm.common import fresh, new_folder, remove_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told; those without letters and those far from every language go.

    Null and empty texts have no letters and go; repeated rows are all judged; all columns come back as they are.
    """
    to = fresh(docs, "__kw_lang")
    return langid.judge(docs, langid.fit(docs), to).where(~F.col(f"{to}.rejected")).drop(to)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Equal ids with different texts are different documents; of repeated rows one stays; rows without id go only if their
    group has another row; null texts are empty and a group of their own; all columns come back as they are.
    """
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark.

    Null and empty texts hold none; an empty benchmark drops nothing; all columns come back as they are.
    """
    to = fresh(docs, "__kw_passages")
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"), to=to)
    return found.where(F.size(to) == 0).drop(to)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced and n_chars the length of the new text; null texts and their lengths stay null."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes they decode to; null texts are empty, repeated rows are repeated."""
    coded = bpe.encode_and_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("decontamination", benchmark_leaks), ("secret_scan", secret_scan), ("byte_bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # read for the last time
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
