"""Corpus pipeline: language ID, near duplicates, benchmark decontamination, PII surrogates, BPE tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from headwater.llm import bpe, decontaminate, language, near, pii, registry
from headwater.session import remove, set_checkpoint_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay, with ``lang`` filled by the prediction where it is null.

    Null, empty and letter-less texts go, and texts of which no language has a third of the probability. Where no row has a language to learn
    from all rows stay as they are. Repeated rows and null ids stay. An empty table gives none; column names may clash.
    """
    return language.keep_identified(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that of the least id (null ids last, ties by a hash of the text).

    Texts without words all stay; a repeated row stays once. An empty table gives none; column names may clash.
    """
    return near.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their ids.

    Null and empty texts stay, and so do repeated clean rows. With an empty benchmark all stay; an empty table gives none.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; n_chars follows. No row goes.

    Null and empty texts stay as they are, repeated rows stay alike. An empty table gives none; column names may clash.
    """
    return pii.rewrite(docs, registry.PII_KEY)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns with the token ids (little-endian 32-bit), their number, and digests of the ids and of the decoded bytes.

    Null text: no ids. A column of the name of one of these gives way to it. An empty table gives none.
    """
    return bpe.bpe(docs, *registry.tokenizer(), keep=tuple(docs.columns), with_ids=True, with_decoded=False)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("bpe_tokens", bpe_tokens),
]

#: Trained models and keyed surrogates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again as the next one's input.

    The folder is the one that spark.checkpoint.dir names (on a cluster it has to). A stage's files go when the next
    stage's are whole; those of the last stay, as the result reads them.
    """
    docs, folder, before = table(spark, sf_dir, "documents"), f"{set_checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
