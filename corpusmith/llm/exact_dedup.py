"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical without the whitespace characters
U+0020 and U+0009 to U+000D. Of equal texts the row with the most code points
stays, then the smallest id (null ids last), then the first row as stored.

A digest that a large part of all rows share would send them to one task. So
Misra-Gries summaries, one per task, find the frequent digests; these are
counted exactly, and their winners (at most ``counters + 1`` rows) are broadcast
so that each task decides about its own rows. All other digests are shared by
few rows each and are shuffled as usual.

Null texts count as empty, empty texts equal each other, repeated rows are
copies of each other, and an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmith.llm.common import WHITESPACE, Batches, keep_rows, stage_rows
from corpusmith.sources.staging import stage

COUNTERS = 1023


def text_digest(text: Column) -> Column:
    """SHA-256 (binary) of the text without whitespace."""
    squeezed = F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "")
    return F.unhex(F.sha2(squeezed, 256))


def misra_gries(counters: int):
    """Summarise a stream of digests by at most ``counters`` counts.

    Batches are merged like summaries: add up, then lower all counts by the
    largest that has no place. A count is too low by at most
    rows / (counters + 1).
    """

    def run(batches: Batches) -> Batches:
        held: dict[bytes, int] = {}
        for batch in batches:
            for item in pc.value_counts(batch.column(0)).to_pylist():
                held[item["values"]] = held.get(item["values"], 0) + item["counts"]
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {d: n - cut for d, n in held.items() if n > cut}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
            ["digest", "n"],
        )

    return run


def frequent_digests(keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Every digest of more than 2 / (counters + 1) of all rows.

    Summed over tasks a count is too low by at most N / (counters + 1), and all
    counts add up to N at most: digests with a sum of N / (counters + 1) or more
    include those wanted, and there are never more than ``counters + 1``.
    """
    total = keys.agg(F.count(F.lit(1))).scalar()
    summaries = keys.select("digest").mapInArrow(misra_gries(counters), "digest binary, n long")
    sums = summaries.groupBy("digest").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") * F.lit(counters + 1) >= total).select("digest")


def _rank() -> Column:
    """The largest one stays."""
    # ~id falls as the id rises, without overflow; nulls are smallest
    return F.struct("n_chars", F.bitwise_not("id"), F.bitwise_not("row_no"))


def decide(keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``(row_no, id, digest, keep_id, group_size, kept)`` for each row of
    ``keys (row_no, id, digest, n_chars)``, a stored table."""
    best = F.max(F.struct(_rank().alias("rank"), "id", "row_no"))
    winners = stage(
        keys.join(F.broadcast(frequent_digests(keys, counters)), "digest")
        .groupBy("digest")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select(
            "digest",
            F.col("best.id").alias("keep_id"),
            F.col("best.row_no").alias("keep_row"),
            "group_size",
        ),
        "dedup-winners",
    )
    columns = ("row_no", "id", "digest", "keep_id", "group_size", "kept")
    in_place = (
        keys.join(F.broadcast(winners), "digest")
        .withColumn("kept", F.col("row_no") == F.col("keep_row"))
        .select(*columns)
    )
    group = W.partitionBy("digest")
    in_order = group.orderBy(_rank().desc())
    shuffled = (
        keys.join(F.broadcast(winners), "digest", "left_anti")
        .select(
            "*",
            F.first("id").over(in_order).alias("keep_id"),
            F.count(F.lit(1)).over(group).alias("group_size"),
            (F.row_number().over(in_order) == 1).alias("kept"),
        )
        .select(*columns)
    )
    return in_place.unionByName(shuffled)


def dedup_report(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``: one row per document."""
    text = F.coalesce(docs["text"], F.lit(""))
    keys = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row_no"),
            docs["doc_id"].alias("id"),
            text_digest(text).alias("digest"),
            F.length(text).alias("n_chars"),
        ),
        "dedup-keys",
    )
    return decide(keys, counters).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = stage_rows(
        docs,
        "dedup-rows",
        id=docs["doc_id"],
        digest=text_digest(docs["text"]),
        n_chars=F.length(F.coalesce(docs["text"], F.lit(""))),
    )
    decided = decide(rows.select("row_no", "id", "digest", "n_chars"), counters)
    return keep_rows(rows, decided.where("kept"))
