"""Corrections for tokens that no dictionary has, by a deletion-neighbourhood index.

Two tokens within ``max_edits`` insertions, deletions and substitutions become equal
when at most ``max_edits`` characters are deleted from each. So known and unknown
tokens are joined on their deletion neighbourhoods, which replaces comparing every
token with every known one; the edit distance of the pairs that meet is then
measured. Of long tokens the first ``prefix`` characters are enough: an alignment
shifts a character by as many places as it inserts, so what of one prefix has no
match in the other prefix is no more than the edits either.

The neighbours of a token are bounded by ``prefix`` and ``max_edits`` alone, and only
distinct tokens travel, never texts. Neighbourhoods are shuffled, never broadcast, and
to a fixed number of tasks: a table of tokens is small and its neighbours are many, so
what Spark would judge by the size of the table ends in one task or in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.functions import text as tx

MAX_EDITS = 2
PREFIX = 8


def token_counts(texts: DataFrame) -> DataFrame:
    """``(token, n)``: how often each token of ``text`` occurs."""
    found = texts.select(F.explode(tx.tokens(F.col("text"))).alias("token"))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def deletions(token: Column, max_edits: int = MAX_EDITS, prefix: int = PREFIX) -> Column:
    """What is left of the first ``prefix`` characters when up to ``max_edits`` go."""

    def shorter(word: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(word))
        cut = F.transform(
            places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))
        )
        return F.when(F.length(word) > 0, cut).otherwise(F.array().cast("array<string>"))

    level = F.array(F.substring(token, 1, prefix))
    levels = [level]
    for _ in range(max_edits):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        levels.append(level)
    return F.array_distinct(F.concat(*levels))


def letters(token: Column) -> Column:
    """The characters of a token as bits of a long: one of the lower 32 if a character
    (modulo 32) occurs, one of the upper 32 if it does again.

    Taking a character away or adding one changes one bit at most.
    """

    def add(seen: Column, char: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(char) % 32)
        again = seen.bitwiseAND(bit) != 0
        return seen.bitwiseOR(F.when(again, F.shiftleft(bit, 32)).otherwise(bit))

    # an empty token is split into one empty string
    chars = F.filter(F.split(token, ""), lambda char: char != "")
    return F.aggregate(chars, F.lit(0).cast("long"), add)


def spelling_corrections(
    unknown: DataFrame, known: DataFrame, max_edits: int = MAX_EDITS, prefix: int = PREFIX
) -> DataFrame:
    """``(token, correction, distance)`` for the tokens of ``unknown (token)`` that have a
    token of ``known (token, n)`` within ``max_edits``.

    The nearest known token counts, among these the commonest, then the smallest.
    Tokens that are known, or null, get no correction.
    """
    if max_edits < 1 or prefix <= max_edits:
        raise ValueError("max_edits must be at least 1 and prefix larger than max_edits")
    spark = unknown.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = known.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("n"))
    wanted = unknown.select("token").distinct().join(counted.hint("merge"), "token", "left_anti")

    def keyed(tokens: DataFrame, token: str, bits: str) -> DataFrame:
        # dealt out before and behind the step that makes many rows of one
        dealt = tokens.repartition(parts, token).withColumn(bits, letters(F.col(token)))
        keys = F.explode(deletions(F.col(token), max_edits, prefix)).alias("key")
        return dealt.select("*", keys).repartition(parts, "key")

    ours = keyed(wanted.where(F.col("token").isNotNull()), "token", "_ours")
    theirs = keyed(counted.withColumnRenamed("token", "correction"), "correction", "_theirs")
    near = F.abs(F.length("token") - F.length("correction")) <= max_edits
    # an edit takes one character at most and adds one at most; cheaper than the distance
    for a, b in (("_ours", "_theirs"), ("_theirs", "_ours")):
        near &= F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(b))) <= max_edits
    distance = F.levenshtein("token", "correction", max_edits)
    best = F.min(F.struct("distance", (-F.col("n")).alias("rank"), "correction")).alias("best")
    return (
        ours.join(theirs.hint("merge"), "key")
        .where(near)
        .withColumn("distance", distance)
        .where(F.col("distance") >= 0)
        .groupBy("token")
        .agg(best)
        .select("token", "best.correction", "best.distance")
    )
