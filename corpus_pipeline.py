"""From raw documents to packed training windows, in stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrubline.llm.common import Scratch, clear, marked
from scrubline.llm.exact_dedup import drop_exact_duplicates
from scrubline.llm.minhash import drop_near_duplicates
from scrubline.llm.packing import pack
from scrubline.llm.quality import drop_poor
from scrubline.llm.suffix_dedup import remove_repeats
from scrubline.llm.token_counts import token_counts
from scrubline.sources import spread


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches the threshold, and those without a text; see ``drop_poor``."""
    return drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of documents with the same text, and all without one; see ``drop_exact_duplicates``."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of near duplicates, and all texts without words; see ``drop_near_duplicates``."""
    return drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur before; ``n_chars`` is that of the text that is left, null without one; see ``remove_repeats``."""
    from pyspark.sql import functions as F

    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes in windows of several lengths, by its real tokens; see ``pack``."""
    return pack(token_counts(docs), length_col="n_tokens")


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: Learnt weights and chains of near duplicates are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; rows (doc_id, piece, doc_start, n_tokens, tier, window_id, window_start, step_group) of ``pack``.

    Null and empty texts pass all stages but the last, which has no window for them; of copies, near copies and repeated passages the first in order
    of id stays. Ids may be of any type that sorts; rows with null or repeated ids are documents of their own. All columns pass, whatever their names. Without
    documents there are no rows. Each stage's result is written to the shared folder, and its intermediate tables go then.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    before = None
    for name, stage in STAGES[:-1]:
        mark = marked()
        after = scratch.write(stage(spark, docs, sf_dir))
        clear(spark, mark)
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
