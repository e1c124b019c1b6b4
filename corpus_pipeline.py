"""A training corpus from raw documents, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from isoflow.llm import decontam, langid, mixing, near_copies, sstable
from isoflow.llm.common import fresh_path, shuffles_dropped


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, null and empty texts and those without a letter; fills null languages in.

    Repeated rows, null ids and further columns stay; an empty table stays empty.
    """
    return langid.identified_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (Jaccard similarity 0.8 of five-word shingles).

    It is the one with the smallest id, nulls last, then the least MD5 of the text. Of rows
    that repeat its id and text the least in the order of the columns stays. Empty and null
    texts are one group. Further columns stay if they can be ordered.
    """
    with shuffles_dropped(spark):
        found = near_copies.near_copy_groups(docs)
    # The rows of a group are first reduced where they are read, so no group is large.
    best = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("b"))
    # The join and the groups have the same keys, none of them null, so whole rows are shuffled once.
    keys = lambda id_, h: (id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), h.alias("h"))
    best = best.select(*keys(F.col("b.id"), F.col("b.h")))
    own = docs.select(F.struct("*").alias("row"), *keys(F.col("doc_id").cast("long"), near_copies.text_hash("text")))
    own = own.join(best, ["none", "id", "h"], "left_semi")
    return own.groupBy("none", "id", "h").agg(F.min("row").alias("row")).select("row.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null ids and texts and repeated rows stay."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or cuts documents so that sources meet their target weights; a row for each repetition.

    A null source is a source; texts without words come once for each whole repetition of theirs.
    """
    return mixing.mixed_copies(docs, max_epochs=3.0, seed=42)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids as shards and returns a digest of each row read back, null ids first; an empty table gives none.

    Workers forget the chunks they met, as what they hold from the stages before leaves little memory.
    """
    return sstable.token_digests(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, remember=False)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
    ("token_ids", write_token_ids),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return out
        path = fresh_path(spark, f"stage-{n}-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
