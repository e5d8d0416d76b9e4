"""Sampling, splitting, shuffling and numbering, all keyed by row hashes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmith.functions.columns import below_fraction, hash_hex
from corpusmith.operators.ranking import kth_rows, number_rows
from corpusmith.sources.staging import stage

# fixed value: format of the identifiers of generated rows
ID_FORMAT = "ynat-v1_train_%05d"
SPLIT_SEED = 456


class Split(NamedTuple):
    train: DataFrame
    valid: DataFrame


def shuffle_rows(df: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """Random order: a range-partitioned sort by hash, no single-task step."""
    return df.orderBy(hash_hex(seed, F.lit("shuffle"), F.col("row_key")), "row_key")


def shuffle_positions(df: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """The place of every row in ``shuffle_rows`` order, from 1."""
    return number_rows(df, hash_hex(seed, F.lit("shuffle"), F.col("row_key")))


def sequential_ids(
    df: DataFrame, id_format: str = ID_FORMAT, seed: int = SPLIT_SEED
) -> DataFrame:
    """Dense identifiers from 1 in a fixed pseudo-random order, as ``ID``."""
    numbered = number_rows(
        df, hash_hex(seed, F.lit("id"), F.col("row_key")), name="_no"
    )
    return numbered.withColumn("ID", F.format_string(id_format, "_no")).drop("_no")


def sample_per_class(
    df: DataFrame, n: int = 10, num_classes: int | None = None, seed: int = SPLIT_SEED
) -> DataFrame:
    """``n`` random rows of each class, with their ``rank``; with ``num_classes``,
    of the classes 0..num_classes-1 alone.

    A histogram over hash buckets finds each class's n-th key; only keys up to
    it, n per class, are ranked and come back to pick up their texts. So neither a
    large class nor a large n brings a class into one task unsorted.
    """
    valid = F.col("target").isNotNull()
    if num_classes is not None:
        valid = F.col("target").between(0, num_classes - 1)
    draw = hash_hex(seed, F.lit("shots"), F.col("row_key"))
    keyed = df.where(valid).select("row_key", "target", draw.alias("_hash"), F.lit(n).alias("_want"))
    last = kth_rows(keyed, ["target"], [], "_hash", "row_key", "_want")
    ends = stage(last.select("target", F.struct("_hash", "row_key").alias("_last")), "shots")
    order = W.partitionBy("target").orderBy("_hash", "row_key")
    keys = (
        keyed.join(ends, "target")
        .where(F.struct("_hash", "row_key") <= F.col("_last"))
        .select("row_key", F.row_number().over(order).alias("rank"))
        .where(F.col("rank") <= n)
    )
    return df.join(keys, "row_key")


def split_hash(
    df: DataFrame, fraction: float = 0.2, seed: int = SPLIT_SEED, key: str = "row_key"
) -> Split:
    """Split by row hash: about ``fraction`` of the rows validate. No shuffle.

    With ``key="ID"`` all variants of one source row stay on one side.
    """
    valid = below_fraction(hash_hex(seed, F.lit("split"), F.col(key)), fraction)
    return Split(df.where(~valid), df.where(valid))


def split_group(df: DataFrame, fraction: float = 0.2, seed: int = SPLIT_SEED) -> Split:
    return split_hash(df, fraction, seed, key="ID")


def split_exact(
    df: DataFrame, fraction: float = 0.2, seed: int = SPLIT_SEED
) -> Split:
    """Split with exactly ceil(fraction * N) validation rows.

    Only the boundary row is searched for, on keys; the texts are then filtered
    against it in place.
    """
    order_hash = hash_hex(seed, F.lit("split"), F.col("row_key"))
    hashed = df.select("row_key", order_hash.alias("_hash"))
    size = hashed.agg(F.ceil(F.count(F.lit(1)) * F.lit(fraction)).cast("bigint"))
    keyed = hashed.withColumn("_k", size.scalar())
    edge = kth_rows(keyed, [], [], "_hash", "row_key", "_k")
    bound = edge.select(F.struct("_hash", "row_key")).scalar()
    row = F.struct(order_hash.alias("_hash"), F.col("row_key"))
    marked = df.withColumn("_valid", F.coalesce(row <= bound, F.lit(False)))
    return Split(
        marked.where(~F.col("_valid")).drop("_valid"),
        marked.where("_valid").drop("_valid"),
    )
