"""Row numbers, ranks and k-th rows without a single-task sort.

An unpartitioned ``row_number()`` sorts everything in one task, and a window
over a hot group sorts that group in one task. Here rows go into ordered
buckets whose number is bounded; the counts per bucket (partially aggregated
before they are shuffled) give each bucket its offset, and only rows of one
bucket are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmith.sources.staging import stage

# 4 hex digits: at most 65,536 buckets per group
BUCKET_DIGITS = 4


def bucket_of(hash_column: Column) -> Column:
    return F.substring(hash_column, 1, BUCKET_DIGITS)


def number_rows(
    df: DataFrame, order_hash: Column, tie: str = "row_key", name: str = "position"
) -> DataFrame:
    """Number all rows 1..N in the order of ``(order_hash, tie)``."""
    hashed = df.withColumn("_hash", order_hash).withColumn(
        "_bucket", bucket_of(F.col("_hash"))
    )
    # no more rows than buckets, so one task for the running sum is fine
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("_bucket")
        .count()
        .select(
            "_bucket",
            F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"),
        )
    )
    inside = W.partitionBy("_bucket").orderBy("_hash", tie)
    return (
        hashed.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .drop("_hash", "_bucket", "_offset")
    )


def rank_rows(
    df: DataFrame,
    value: str,
    order_hash: Column,
    tie: str = "row_key",
    name: str = "rank",
) -> DataFrame:
    """Number all rows 1..N by ``(value, order_hash, tie)``.

    ``value`` is an integer column with a bounded number of distinct values,
    such as a probability in millionths. Rows that share a value are split into
    hash buckets, so a value that a third of all rows share stays distributed.
    """
    hashed = df.withColumn("_hash", order_hash).withColumn(
        "_bucket", bucket_of(F.col("_hash"))
    )
    counts = hashed.groupBy(value, "_bucket").count()
    before_value = W.orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    value_offsets = (
        counts.groupBy(value)
        .agg(F.sum("count").alias("count"))
        .select(value, F.coalesce(F.sum("count").over(before_value), F.lit(0)).alias("_v"))
    )
    before_bucket = (
        W.partitionBy(value).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = (
        counts.withColumn(
            "_b", F.coalesce(F.sum("count").over(before_bucket), F.lit(0))
        )
        .join(value_offsets, value)
        .select(value, "_bucket", (F.col("_v") + F.col("_b")).alias("_offset"))
    )
    inside = W.partitionBy(value, "_bucket").orderBy("_hash", tie)
    return (
        hashed.join(offsets, [value, "_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .drop("_hash", "_bucket", "_offset")
    )


def kth_rows(
    df: DataFrame,
    groups: Sequence[str],
    values: Sequence[str],
    hash_column: str,
    tie: str,
    k: str,
) -> DataFrame:
    """Per group, the k-th row by ``(*values, hash_column, tie)``.

    ``k`` is a column of ``df`` that is constant within its group; a group with
    fewer than k rows yields its last row. Each of the ``values`` has a bounded
    number of distinct integers. A histogram over the first value, then over the
    next, then over the hash buckets, narrows the search down to one bucket per
    group before anything is sorted. Result: ``groups`` and the order columns,
    one row per group.
    """
    groups, values = list(groups), list(values)
    bucket = bucket_of(F.col(hash_column)).alias("_bucket")
    rows = df.select(*groups, *values, hash_column, tie, bucket, k)
    for level in [*values, "_bucket"]:
        histogram = rows.groupBy(*groups, level).agg(
            F.count(F.lit(1)).alias("_n"), F.first(k).alias(k)
        )
        # One row per group. Staged, or each level would run those before it again;
        # Spark then knows its size and broadcasts it if it is small.
        cut = stage(cut_off(histogram, groups, [level], k, "_n"), "cut")
        rows = rows.drop(k).join(cut, [*groups, level])
    inside = W.partitionBy(*groups).orderBy(hash_column, tie)
    return (
        rows.withColumn("_i", F.row_number().over(inside))
        .where(F.col("_i") == F.col(k))
        .select(*groups, *values, hash_column, tie)
    )


def kth_rows_at_once(
    df: DataFrame,
    groups: Sequence[str],
    values: Sequence[str],
    hash_column: str,
    tie: str,
    k: str,
) -> DataFrame:
    """As ``kth_rows``, with one histogram over ``values`` and hash buckets together:
    for tables that were narrowed down before, where a group has few values."""
    groups, values = list(groups), list(values)
    bucket = bucket_of(F.col(hash_column)).alias("_bucket")
    rows = df.select(*groups, *values, hash_column, tie, bucket, k)
    levels = [*values, "_bucket"]
    histogram = rows.groupBy(*groups, *levels).agg(F.count(F.lit(1)).alias("_n"), F.first(k).alias(k))
    cut = cut_off(histogram, groups, levels, k, "_n")
    inside = W.partitionBy(*groups).orderBy(hash_column, tie)
    return (
        rows.drop(k)
        .join(cut, [*groups, *levels])
        .withColumn("_i", F.row_number().over(inside))
        .where(F.col("_i") == F.col(k))
        .select(*groups, *values, hash_column, tie)
    )


def cut_off(
    histogram: DataFrame, groups: Sequence[str], levels: Sequence[str], k: str, n: str
) -> DataFrame:
    """The entry (``levels``) of each group's histogram that holds its k-th row, or its
    last row, and ``k`` within that entry. ``n`` counts the rows of an entry."""
    upto = W.partitionBy(*groups).orderBy(*levels).rowsBetween(W.unboundedPreceding, 0)
    total = W.partitionBy(*groups)
    wanted = F.least(F.col(k), F.col("_total"))
    return (
        histogram.withColumn("_cum", F.sum(n).over(upto))
        .withColumn("_total", F.sum(n).over(total))
        .where((F.col("_cum") >= wanted) & (F.col("_cum") - F.col(n) < wanted))
        .select(*groups, *levels, (wanted - F.col("_cum") + F.col(n)).alias(k))
    )
