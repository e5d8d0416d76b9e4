"""A corpus from raw documents to token ids, stage by stage.

Each stage takes what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmith.llm import byte_bpe, exact_dedup, mixing, repetition, simhash
from corpusmith.llm.common import table
from corpusmith.llm.queries import bpe_digests, mixture
from corpusmith.sources.staging import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are too short or repeat themselves go.

    A null or empty text has no words and goes. Each row is judged for itself, so repeated
    rows and rows with equal or null ids go or stay alike. An empty table stays empty.
    """
    return repetition.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays: the longest, then that of the smallest id.

    A null text counts as empty. Of repeated rows one stays; null ids come last. An empty
    table stays empty.
    """
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest id stays. Near is
    what it is in op9, whose contract this stage keeps; the README has its recall.

    Null and empty texts are near each other; of rows with one id one stays; null ids
    count only where a group has no other. An empty table stays empty.
    """
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a document is there once for each
    pass that takes it.

    Texts without words take nothing of a share; a null language or source is one of its
    own; ties in the seeded order are broken by id. An empty table stays empty.
    """
    levels, weights = mixture(docs)
    return mixing.mix(docs, levels, weights=weights)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)``; ids are
    little-endian unsigned 32-bit integers. One row per row; null and empty texts have
    no ids."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return encoded.select("doc_id", *bpe_digests(encoded), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", token_ids),
]

# rolling hashes, fingerprints and tokenizers are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
