"""A training corpus in five stages, each one operator of ``funnelkit.llm`` over all rows that
the stage before it kept.

Every stage handles null ids, texts and sources, empty and very long texts, ties and repeated
rows, empty tables and further columns, as its operator's docstring says; all but the last
return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from funnelkit.llm.common import materialize, read_table
from funnelkit.llm.curriculum import mix_documents
from funnelkit.llm.exact_dedup import drop_exact_duplicates
from funnelkit.llm.packing import pack_documents
from funnelkit.llm.quality import keep_good
from funnelkit.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees (fitted on the table ``labels``) predict to be good."""
    return keep_good(spark, docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest doc_id."""
    return drop_exact_duplicates(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (shingles of 3 words, 2 bits): the smallest doc_id."""
    return drop_near_duplicates(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them, whole, in training order."""
    return mix_documents(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    import public_tokenizers

    return pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash", near), ("mix", mix), ("packing", pack)]

#: Boosted trees, SimHash components and a local search are not SQL; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; what a stage returns is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
