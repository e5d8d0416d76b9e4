"""Measuring noise and separating noisy from clean rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.functions import text as tx
from corpusmith.profiles import GROUP_BINS, KOREAN, TextProfile


class Isolated(NamedTuple):
    noisy: DataFrame
    clean: DataFrame


def measure_noise(
    df: DataFrame, mode: str = "hard", profile: TextProfile = KOREAN
) -> DataFrame:
    """Add ``noise_ratio``; soft mode also replaces the text by its cleaned form."""
    if mode == "hard":
        return df.withColumn("noise_ratio", tx.hard_noise_ratio(F.col("text"), profile))
    if mode == "soft":
        return df.withColumn("text", tx.soft_clean_text(F.col("text"))).withColumn(
            "noise_ratio", tx.soft_noise_ratio(F.col("text"), profile)
        )
    raise ValueError(f"unknown isolation mode {mode!r}: use 'hard' or 'soft'")


def noisy_when(mode: str, profile: TextProfile = KOREAN) -> Column:
    r = F.col("noise_ratio")
    if mode == "hard":
        return r > 0
    return (r > profile.soft_low) & (r <= profile.soft_high)


def clean_when(mode: str, profile: TextProfile = KOREAN) -> Column:
    r = F.col("noise_ratio")
    return r == 0 if mode == "hard" else r <= profile.soft_clean


def split_measured(
    measured: DataFrame, mode: str = "hard", profile: TextProfile = KOREAN
) -> Isolated:
    """Both sides of a frame that already has ``noise_ratio``.

    Hard mode splits the non-null rows in two. Soft mode does not partition:
    rows in (soft_low, soft_clean] are on both sides, rows above soft_high and
    empty rows on neither. A null ratio is on neither side.
    """
    noisy = measured.where(noisy_when(mode, profile)).drop("noise_ratio")
    clean = measured.where(clean_when(mode, profile)).drop("noise_ratio")
    return Isolated(noisy, clean)


def isolate(
    df: DataFrame, mode: str = "hard", profile: TextProfile = KOREAN
) -> Isolated:
    """Noisy and clean rows of a corpus, measured on the fly."""
    return split_measured(measure_noise(df, mode, profile), mode, profile)


def isolation_summary(
    measured: DataFrame, mode: str = "hard", profile: TextProfile = KOREAN
) -> DataFrame:
    """Row counts of every outcome, in one pass."""
    noisy = F.coalesce(noisy_when(mode, profile), F.lit(False))
    clean = F.coalesce(clean_when(mode, profile), F.lit(False))
    return measured.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(noisy).alias("n_noisy"),
        F.count_if(clean).alias("n_clean"),
        F.count_if(noisy & clean).alias("n_both"),
        F.count_if(~noisy & ~clean).alias("n_neither"),
        F.count_if(F.col("noise_ratio").isNull()).alias("n_rejected"),
    )


def noise_group(
    ratio: Column, bins: Sequence[tuple[float, str]] = GROUP_BINS
) -> Column:
    """Label of the right-closed bin a ratio falls into; null outside all bins."""
    label = F.when(ratio <= bins[0][0], F.lit(bins[0][1]))
    for upper, name in bins[1:]:
        label = label.when(ratio <= upper, F.lit(name))
    return F.when(ratio >= 0, label)


def noise_histogram(
    measured: DataFrame, bins: Sequence[tuple[float, str]] = GROUP_BINS
) -> DataFrame:
    """Rows per noise group in bin order, empty groups included.

    One global aggregation with one counter per bin: only a single small row
    leaves each task, however many rows share a bin.
    """
    group = noise_group(F.col("noise_ratio"), bins)
    counts = [
        F.struct(
            F.lit(i).alias("bin_no"),
            F.lit(label).alias("noise_group"),
            F.count_if(group == label).alias("n_rows"),
        )
        for i, (_, label) in enumerate(bins)
    ]
    return measured.agg(F.array(*counts).alias("bins")).select(F.inline("bins"))
