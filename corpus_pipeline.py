"""A training corpus from ``documents``: without toxic documents, in a known language, one of each group of near
copies, without passages that repeat an earlier document, packed into windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm import jaccard_join, language_id, packing, suffix_dedup, toxicity
from cohortlab.llm.common import Scratch, table, tokenizer_path

#: Below this share of saved distance a text is in no language that was learned.
MIN_LANGUAGE_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), toxicity.Toxicity().threshold)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.in_known_language(docs, language_id.learn(docs), MIN_LANGUAGE_SCORE)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, jaccard_join.JaccardJoin(width=5, percent=80))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Its workers have served the other stages before, so they are given less for words that they know.
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), packing.Packing(memo_bytes=32 << 20))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_languages),
    ("n-gram Jaccard join", keep_one_near_copy),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack_windows),
]

#: Learned models, components and packing are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = scratch.cut(out, f"stage{i}")
    return docs
