"""A training corpus from `documents`: reject toxic texts, deduplicate twice, mix sources, encode.

Each stage reads, as a written table, what the one before it kept. All but the last
return the columns of `documents`; the last returns one row per training occurrence.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelkit.llm import bpe, chosenpath, dedup, mixing, simhash, toxicity
from panelkit.llm.frames import small_batches, table
from panelkit.session import materialize

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Words of a shingle in the near dedup.
WIDTH = 5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, learned from `labels`, is below the threshold."""
    small_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return dedup.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word Jaccard similarity of 0.8 or more the row with the smallest id stays.

    SimHash over five-word shingles proposes pairs, which the whole shingle sets confirm. The chosen-path join adds the
    links of pairs whose fingerprints lie further apart than SimHash can search.
    """
    def propose(rows: DataFrame) -> DataFrame:
        return simhash.near_pairs(rows, "row", width=WIDTH)

    return chosenpath.keep_one(docs, width=WIDTH, num=4, den=5, propose=propose)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in order of their training position."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each occurrence encoded and decoded again: doc_id, n_tokens, digests of ids and bytes."""
    small_batches(spark)
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# Boosted trees decide the first stage, which SQL can't express; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
