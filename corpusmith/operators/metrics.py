"""Classification metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_f1(
    df: DataFrame, label: str = "target", pred: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """F1 per class seen among labels or predictions; 0 without true positives. ``by``
    names columns whose groups are judged for themselves.

    Rows without a label are left out; a missing prediction is a miss of its label.
    Only the confusion counts (classes x classes) go past the first aggregation.
    """
    confusion = df.where(F.col(label).isNotNull()).groupBy(*by, label, pred).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col(label).eqNullSafe(F.col(pred))
    sides = F.array(
        F.struct(
            F.col(label).cast("int").alias("class"),
            F.when(hit, F.col("n")).otherwise(0).alias("tp2"),
            F.col("n").alias("seen"),
        ),
        F.struct(
            F.col(pred).cast("int").alias("class"),
            F.when(hit, F.col("n")).otherwise(0).alias("tp2"),
            F.col("n").alias("seen"),
        ),
    )
    # 2 tp / (2 tp + fp + fn): each true positive is seen once per side
    return (
        confusion.select(*by, F.inline(sides))
        .where(F.col("class").isNotNull())
        .groupBy(*by, "class")
        .agg((F.sum("tp2") / F.sum("seen")).alias("f1"))
    )


def macro_f1(
    df: DataFrame, label: str = "target", pred: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Unweighted mean of the class F1 values, one row (or one per group of ``by``)."""
    return class_f1(df, label, pred, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
