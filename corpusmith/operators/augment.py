"""Shuffle-free text variants, and the rule that adds them up.

A frame here has ``row_key``, ``text`` and any further columns. A variant keeps
the further columns and gets a ``row_key`` of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.functions import text as tx
from corpusmith.profiles import KOREAN, TextProfile

Step = Callable[[DataFrame], DataFrame]


def variants(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """One output row per entry of ``texts``, from a single scan of ``df``.

    The output has ``aug_kind`` (the entry's name), and ``row_key#aug_kind`` as
    its new ``row_key``.
    """
    others = [c for c in df.columns if c not in ("row_key", "text", "aug_kind")]
    rows = F.array(
        *[
            F.struct(F.lit(kind).alias("aug_kind"), text.alias("text"))
            for kind, text in texts.items()
        ]
    )
    out = df.select("row_key", *others, F.inline(rows))
    return out.withColumn("row_key", variant_key(F.col("row_key"), F.col("aug_kind")))


def variant_key(row_key: Column, kind: Column) -> Column:
    return F.concat_ws("#", row_key, kind)


def naive_augment(df: DataFrame, profile: TextProfile = KOREAN) -> DataFrame:
    """Original, special characters removed, lower-cased, double-spaced: 4 rows."""
    text = F.col("text")
    return variants(
        df,
        {
            "original": text,
            "plain": tx.remove_special(text, profile),
            "lower": F.lower(text),
            "spaced": tx.double_spaces(text),
        },
    )


def noise_filtering(df: DataFrame, profile: TextProfile = KOREAN) -> DataFrame:
    """Keep the allowed runs of each text only; null becomes empty. 1 row."""
    return variants(df, {"filtered": tx.keep_allowed(F.col("text"), profile)})


def augment(base: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Everything the steps produce from one base frame (UNION ALL).

    A step sees the base frame and not the output of the steps before it; use
    another base frame to start over.
    """
    return reduce(DataFrame.unionByName, [step(base) for step in steps])
