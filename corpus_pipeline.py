"""A corpus pipeline: quality, language, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's docs.  All but the last return the columns
of documents; the last returns the token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import hyperminhash, lang_zstd, prefix_bpe, raking, site_bayes
from rivulet.llm.common import scratch, work_dir
from rivulet.llm.queries import mix_dims, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-aware quality classifier keeps."""
    return site_bayes.good_documents(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; the language they claim is not compared."""
    return lang_zstd.identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five words, similarity 0.8 or more."""
    return hyperminhash.deduplicated(docs, 5, 80, 100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the smoothed shares of sources, languages and topics."""
    return raking.sampled(docs, mix_dims())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, and the ids of the whole text with their digests."""
    return prefix_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                   columns=["doc_id", "source", "lang"])


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("mix", mix), ("tokens", tokens)]

#: The classifier of the first stage cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, name)
        with scratch(spark):  # what the stage wrote on its way goes once its result is there
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
