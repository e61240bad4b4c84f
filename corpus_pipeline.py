"""From raw documents to packed sequences: quality, exact copies, near copies, mix, packing.

Every stage reads what the one before it wrote. Near copies are those with Jaccard similarity of 0.8 or more over five-word shingles.

Defined cases. Null text: the empty text, scored like any other, one copy of it stays, the mix takes it never (size 0). Null doc_id: a document like others, whose quality label
is unknown. Rows that repeat doc_id and text: one stays. Rows that repeat only doc_id: decided each on its own. Very long texts: cut into pieces by the last stage only. Empty
table: no rows. Other columns, whatever their names, stay as they are until the last stage, which returns its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import common, exact_dedup, jaccard, mixing, packing, quality


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, common.load(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, jaccard.Reach(80, 100, 5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]
#: Training, hashing into blocks and tokenizing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = common.sealed(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if hasattr(docs, "made_at"):
            common.discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
