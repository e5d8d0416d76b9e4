"""Finding and repairing doubtful labels from class scores.

A scored frame has ``row_key``, ``target`` and ``probs`` (array of num_classes
doubles). Scores are taken in millionths, so that sums, comparisons and ties do
not depend on summation order or partitioning.

Label issues follow confident learning, "prune by noise rate" (Northcutt, Jiang
& Chuang 2021): see ``flag_issues``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.columns import argmax, hash_hex, let, mean_vectors, micro
from corpusmith.operators.ranking import cut_off, kth_rows_at_once, rank_rows
from corpusmith.sources.staging import stage

RANK_SEED = 42
# millionths of a score in a step of the histogram of a cell
STEP = 1000


# --- ensembles ---------------------------------------------------------------


def ensemble_label(raw_scores: Sequence[Column]) -> Column:
    """Arg-max of the mean of several models' raw scores on the same row."""
    return argmax(mean_vectors(list(raw_scores)))


def mean_scores(scored: DataFrame, num_classes: int) -> DataFrame:
    """Mean score vector per row of a long table ``(row_key, model, raw)``.

    One average per class, so the partial sums are merged before the shuffle.
    """
    means = [F.avg(F.col("raw")[i]) for i in range(num_classes)]
    return scored.groupBy("row_key").agg(F.array(*means).alias("raw"))


def overwrite_target(df: DataFrame, label: Column) -> DataFrame:
    """Replace every target by a predicted label."""
    return df.withColumn("target", label.cast("int"))


# --- confident learning -------------------------------------------------------


def _in_micro(scored: DataFrame) -> DataFrame:
    return scored.select(
        "row_key", "target", F.transform("probs", micro).alias("p")
    )


def _thresholds(rows: DataFrame, num_classes: int) -> DataFrame:
    """One row: array with the mean self-confidence of each class, in millionths.

    A global aggregation with one (sum, count) pair per class; null for a class
    without rows.
    """
    means = []
    for c in range(num_classes):
        mine = F.col("target") == c
        total = F.sum(F.when(mine, F.col("p")[c])).cast("double")
        means.append(F.try_divide(total, F.count_if(mine).cast("double")))
    return rows.agg(F.array(*means).alias("t"))


def label_thresholds(scored: DataFrame, num_classes: int) -> DataFrame:
    """Mean self-confidence per class: ``(target, threshold)``."""
    t = _thresholds(_in_micro(scored), num_classes)
    return (
        t.select(F.posexplode("t").alias("target", "t"))
        .where(F.col("t").isNotNull())
        .select("target", (F.col("t") / 1_000_000.0).alias("threshold"))
    )


def _confident_class(p: Column, t: Column) -> Column:
    """The class a row is confident in: the largest p_j with p_j >= t_j."""
    # probabilities are not negative, so -1 marks "below the threshold"
    confident = F.zip_with(
        p, t, lambda x, bound: F.when(x >= bound, x).otherwise(F.lit(-1))
    )
    return let(confident, lambda c: F.when(F.array_max(c) >= 0, argmax(c)))


def _guesses(rows: DataFrame, num_classes: int) -> DataFrame:
    bounds = rows.withColumn("_t", _thresholds(rows, num_classes).scalar())
    return bounds.withColumn("guess", _confident_class(F.col("p"), F.col("_t"))).drop("_t")


def _joint(rows: DataFrame, num_classes: int) -> DataFrame:
    return _guesses(rows, num_classes).groupBy("target", "guess").agg(F.count(F.lit(1)).alias("n"))


def _cell_counts(rows: DataFrame, num_classes: int) -> DataFrame:
    """All that cut-offs need, in one aggregation: ``(target, step, j, n)``.

    With a null step it is the joint of label and confident class ``j``, else the
    histogram of the shortfalls towards class ``j`` in steps of ``STEP``. Every task
    adds up its own rows first; there are at most num_classes ** 2 * 2,002 counts.
    """
    p, i = F.col("p"), F.col("target")
    step = F.lit(None).cast("int").alias("step")
    joint = F.array(F.struct(F.col("guess").cast("int").alias("j"), step))
    classes = F.sequence(F.lit(0), F.lit(num_classes - 1))
    others = F.transform(
        F.filter(classes, lambda j: j != i),
        lambda j: F.struct(j.cast("int").alias("j"), _step(_shortfall(p, i, j)).alias("step")),
    )
    known = F.coalesce(F.filter(others, lambda x: x["step"].isNotNull()), F.array().cast("array<struct<j:int,step:int>>"))
    counted = _guesses(rows, num_classes).select("target", F.inline(F.concat(joint, known)))
    return counted.groupBy("target", "step", "j").agg(F.count(F.lit(1)).alias("n"))


def confident_joint(scored: DataFrame, num_classes: int) -> DataFrame:
    """Rows per (label, confident class), raw (``n``) and calibrated.

    Calibration scales each label's counts to the number of rows with that label
    and rounds half up, in integer arithmetic.
    """
    return _calibrated(_joint(_in_micro(scored), num_classes))


def _calibrated(joint: DataFrame) -> DataFrame:
    # at most num_classes * (num_classes + 1) rows from here on
    sums = joint.groupBy("target").agg(
        F.sum("n").alias("_rows"),
        F.sum(F.when(F.col("guess").isNotNull(), F.col("n"))).alias("_confident"),
    )
    return (
        joint.where(F.col("guess").isNotNull())
        .join(F.broadcast(sums), "target")
        .select(
            "target",
            "guess",
            "n",
            F.expr("(2 * n * _rows + _confident) div (2 * _confident)").alias(
                "calibrated"
            ),
        )
    )


def flag_issues(scored: DataFrame, num_classes: int) -> DataFrame:
    """Add ``suggested`` (arg-max class) and ``is_issue`` to a scored frame.

    For labels i and classes j != i the calibrated joint says how many rows
    labelled i should be j; that many rows with the largest p_j - p_i are
    flagged, ties in hash order, unless the arg-max is the given label.

    One aggregation counts the joint and a histogram of every (i, j) cell; it says
    in which step the cut-off of each cell lies. Only rows of these steps are
    looked at again for the cut-off row itself, so no cell is ever sorted in one
    task. Flagging compares each row with at most num_classes cut-offs in place.
    """
    rows = _in_micro(scored)
    counts = stage(_cell_counts(rows, num_classes), "cells")
    joint = counts.where("step is null").select("target", F.col("j").alias("guess"), "n")
    wanted = _calibrated(joint).where((F.col("guess") != F.col("target")) & (F.col("calibrated") > 0))
    histogram = counts.where("step is not null").join(
        F.broadcast(wanted.select("target", F.col("guess").alias("j"), F.col("calibrated").alias("k"))), ["target", "j"]
    )
    # one step per cell, so at most num_classes ** 2 rows
    steps = cut_off(histogram, ["target", "j"], ["step"], "k", "n")
    order_hash = hash_hex(RANK_SEED, F.col("row_key"))
    shortfall = _shortfall(F.col("p"), F.col("target"), F.col("j"))
    near = stage(
        rows.join(F.broadcast(steps), "target")
        .select("target", "j", "step", "k", shortfall.alias("shortfall"), order_hash.alias("h"), "row_key")
        .where(_step(F.col("shortfall")) == F.col("step"))
        .drop("step"),
        "near",
    )
    edges = kth_rows_at_once(near, ["target", "j"], ["shortfall"], "h", "row_key", "k")
    # at most num_classes rows with at most num_classes cut-offs each
    bounds = edges.groupBy("target").agg(
        F.collect_list(F.struct("j", "shortfall", "h", "row_key")).alias("_bounds")
    )

    def in_any_cell(mine: Column) -> Column:
        def within(bound: Column) -> Column:
            shortfall = _shortfall(mine["p"], F.col("target"), bound["j"])
            row = F.struct(shortfall, mine["h"], F.col("row_key"))
            return row <= F.struct(bound["shortfall"], bound["h"], bound["row_key"])

        return F.exists("_bounds", within)

    p = F.transform("probs", micro)
    mine = F.struct(p.alias("p"), order_hash.alias("h"))
    in_cell = F.coalesce(let(mine, in_any_cell), F.lit(False))
    suggested = argmax(p)
    return (
        scored.join(bounds, "target", "left")
        .withColumn("suggested", suggested)
        .withColumn("is_issue", in_cell & (F.col("suggested") != F.col("target")))
        .drop("_bounds")
        .select(*scored.columns, "suggested", "is_issue")
    )


def _step(shortfall: Column) -> Column:
    return F.floor(shortfall / STEP).cast("int")


def _shortfall(p: Column, i: Column, j: Column) -> Column:
    """p_i - p_j in millionths: the smaller, the more the row looks like j."""
    return F.get(p, i) - F.get(p, j)


def label_issues(flagged: DataFrame) -> DataFrame:
    """The issues of a flagged frame, ranked by self-confidence, lowest first."""
    confidence = micro(F.get("probs", F.col("target")))
    issues = flagged.where("is_issue").select(
        "row_key", "target", "suggested", confidence.alias("self_confidence")
    )
    return rank_rows(
        issues, "self_confidence", hash_hex(RANK_SEED, F.col("row_key"))
    ).withColumn("self_confidence", F.col("self_confidence") / 1_000_000.0)


def corrected_target() -> Column:
    """Target of a flagged frame after correction: issues and rows without a
    label take the suggestion."""
    doubtful = F.col("is_issue") | F.col("target").isNull()
    return F.when(doubtful, F.col("suggested")).otherwise(F.col("target"))


def apply_corrections(df: DataFrame, issues: DataFrame) -> DataFrame:
    """Write suggestions back by row key; all other rows keep their target. Of
    several suggestions for a key the smallest counts."""
    new = issues.groupBy("row_key").agg(F.min("suggested").alias("_new"))
    return (
        df.join(new, "row_key", "left")
        .withColumn("target", F.coalesce("_new", "target"))
        .drop("_new")
    )


def issue_texts(df: DataFrame, issues: DataFrame) -> DataFrame:
    """The corpus rows behind a table of issues."""
    return df.join(issues.select("row_key"), "row_key", "left_semi")
