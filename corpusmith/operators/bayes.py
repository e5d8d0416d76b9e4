"""Multinomial naive Bayes on hashed n-grams of tokens.

Counts are integers and log probabilities are whole millionths, so a model and
its scores do not depend on partitioning or on the order of sums. Each n-gram is
hashed to one of ``num_features`` numbers, which bounds a model's size: it is one
row of num_features x num_classes integers, and rows are scored in place by it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.columns import hash_hex, hash_u32, let, micro, softmax
from corpusmith.functions.text import tokens
from corpusmith.operators.sampling import SPLIT_SEED
from corpusmith.sources.staging import stage

# at most this many numbers in a model (8 bytes each)
MAX_WEIGHTS = 1 << 20
# tokens made once for several models that score the same rows
SHARED = "_shared_words"
# the place of the number of rows among the counts of features
_ROWS = -1


@dataclass(frozen=True)
class BayesSpec:
    """``ngram`` tokens make one feature; texts with fewer tokens have none."""

    ngram: int = 1
    num_features: int = 1 << 12
    num_classes: int = 7

    def __post_init__(self):
        if self.num_features * self.num_classes > MAX_WEIGHTS:
            raise ValueError(f"a model holds at most {MAX_WEIGHTS} numbers")


@dataclass(frozen=True)
class BayesModel:
    """``table`` has one row: ``prior`` (per class) and ``weights`` (per feature and
    class), in millionths of natural logarithms."""

    spec: BayesSpec
    table: DataFrame

    def score(self, df: DataFrame, probs: str, raw: str) -> DataFrame:
        """Add class probabilities and log scores; a null text counts as empty."""
        # used once below, so that it stays a constant and is never copied into rows
        with_model = df.withColumn("_model", self.table.select(F.struct("prior", "weights")).scalar())
        return _scored(with_model, df.columns, F.col("_model"), self.spec, probs, raw)


@dataclass(frozen=True)
class BayesFolds:
    """One model per fold, learned from the rows of all other folds. ``table`` has one
    row: ``models``, an array of ``prior`` and ``weights`` as in ``BayesModel``."""

    spec: BayesSpec
    folds: int
    table: DataFrame

    def score(self, df: DataFrame, probs: str, raw: str) -> DataFrame:
        """Add the scores of the model that has not seen the row."""
        with_models = df.withColumn("_models", self.table.select("models").scalar())
        mine = F.get("_models", fold_number(self.folds))
        return _scored(with_models, df.columns, mine, self.spec, probs, raw)


def _scored(
    df: DataFrame, columns: list[str], model: Column, spec: BayesSpec, probs: str, raw: str
) -> DataFrame:
    def total(bound: Column, c: int) -> Column:
        def add(acc: Column, x: Column) -> Column:
            return acc + F.get(F.get(bound["model"]["weights"], x), F.lit(c))

        start = F.get(bound["model"]["prior"], F.lit(c))
        return F.aggregate(bound["found"], start, add) / F.lit(1e6)

    def totals(bound: Column) -> Column:
        return F.array(*[total(bound, c) for c in range(spec.num_classes)])

    toks = F.col(SHARED) if SHARED in columns else None
    bound = F.struct(features(spec, toks).alias("found"), model.alias("model"))
    scored = df.select(*columns, let(bound, totals).alias(raw))
    return scored.select(*columns, softmax(F.col(raw)).alias(probs), raw)


def fold_number(folds: int, key: str = "row_key") -> Column:
    """The fold of a row, 0 to ``folds - 1``, by its key."""
    return (hash_u32(hash_hex(SPLIT_SEED, F.lit("fold"), F.col(key))) % folds).cast("int")


def words() -> Column:
    """The tokens of ``text``, of which all specifications make their features."""
    return tokens(F.coalesce(F.col("text"), F.lit("")))


def features(spec: BayesSpec, toks: Column | None = None) -> Column:
    """The feature number of each n-gram of ``text``, repeats included. ``toks`` are its
    ``words``, where several specifications share them."""

    def grams(found: Column) -> Column:
        # from token to token: slices would copy each token ngram times
        places = F.sequence(F.lit(0), F.size(found) - spec.ngram)
        several = F.transform(
            places, lambda i: F.concat_ws(" ", *[F.get(found, i + k) for k in range(spec.ngram)])
        )
        return F.when(F.size(found) >= spec.ngram, several).otherwise(F.array().cast("array<string>"))

    toks = words() if toks is None else toks
    found = toks if spec.ngram == 1 else let(toks, grams)
    return F.transform(
        found, lambda g: (hash_u32(F.md5(g)) % spec.num_features).cast("int")
    )


def _log_share(count: Column, size: Column) -> Column:
    return micro(F.log((count + 1).cast("double") / size.cast("double")))


def train_bayes(df: DataFrame, spec: BayesSpec = BayesSpec()) -> BayesModel:
    """Count features per class, with one added to each count.

    Rows without a target, or with one outside 0..num_classes-1, are left out;
    without any rows all classes are equal.
    """
    names = [f"c{c}" for c in range(spec.num_classes)]
    seen = F.concat(F.array(F.lit(_ROWS)), features(spec))
    # tasks merge their counts first, so at most num_features + 1 rows each leave
    # them, and no more are stored
    counts = stage(
        df.where(F.col("target").between(0, spec.num_classes - 1))
        .select("target", F.explode(seen).alias("feature"))
        .groupBy("feature")
        .agg(*[F.count_if(F.col("target") == c).alias(name) for c, name in enumerate(names)]),
        "bayes-counts",
    )

    def sizes(rows: DataFrame) -> Column:
        sums = [F.coalesce(F.sum(name), F.lit(0)) for name in names]
        return rows.agg(F.array(*sums)).scalar()

    numbered = df.sparkSession.range(spec.num_features).select(F.col("id").cast("int").alias("feature"))
    logs = [
        _log_share(F.coalesce(name, F.lit(0)), F.col("_sizes")[c] + spec.num_features)
        for c, name in enumerate(names)
    ]
    weights = (
        numbered.join(counts, "feature", "left")
        .withColumn("_sizes", sizes(counts.where(F.col("feature") != _ROWS)))
        .select("feature", F.array(*logs).alias("logs"))
        .agg(F.sort_array(F.collect_list(F.struct("feature", "logs")))["logs"].alias("weights"))
    )
    rows = sizes(counts.where(F.col("feature") == _ROWS))
    all_rows = sum(F.col("_rows")[c] for c in range(spec.num_classes))
    prior = F.array(
        *[_log_share(F.col("_rows")[c], all_rows + spec.num_classes) for c in range(spec.num_classes)]
    )
    table = weights.withColumn("_rows", rows).select(prior.alias("prior"), "weights")
    return BayesModel(spec, table)


def train_folds(df: DataFrame, specs: Sequence[BayesSpec], folds: int) -> list[BayesFolds]:
    """Models of every specification for cross-validation in ``folds`` folds.

    One pass counts the features of all specifications per fold and class. What
    a model without fold k has seen is the sum of all folds less fold k, so no
    model needs a pass of its own. Rows are left out as in ``train_bayes``.
    """
    classes = {spec.num_classes for spec in specs}
    if len(classes) != 1 or folds < 2:
        raise ValueError("two folds or more, and specifications with the same classes")
    n_classes = classes.pop()
    if any(spec.num_features * n_classes * folds > MAX_WEIGHTS for spec in specs):
        raise ValueError(f"the models of all folds hold at most {MAX_WEIGHTS} numbers")
    cells = [(k, c) for k in range(folds) for c in range(n_classes)]

    def seen(number: int, spec: BayesSpec) -> Column:
        found = F.concat(F.array(F.lit(_ROWS)), features(spec, F.col("_words")))
        return F.transform(found, lambda f: F.struct(F.lit(number).alias("spec"), f.alias("feature")))

    # one counter per n-gram first; those of a feature's folds and classes meet afterwards
    known = df.where(F.col("target").between(0, n_classes - 1))
    counted = (
        known.select("target", fold_number(folds).alias("fold"), words().alias("_words"))
        .select("target", "fold", F.inline(F.concat(*[seen(i, spec) for i, spec in enumerate(specs)])))
        .groupBy("spec", "feature", "fold", "target")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    own = [((F.col("fold") == k) & (F.col("target") == c), f"n{k}_{c}") for k, c in cells]
    counts = stage(
        counted.groupBy("spec", "feature").agg(
            *[F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias(name) for mine, name in own]
        ),
        "bayes-folds",
    )
    return [
        BayesFolds(spec, folds, _fold_models(counts.where(F.col("spec") == i), spec, folds))
        for i, spec in enumerate(specs)
    ]


def _fold_models(counts: DataFrame, spec: BayesSpec, folds: int) -> DataFrame:
    classes = range(spec.num_classes)

    def others(own: Callable[[int, int], Column]) -> list[list[Column]]:
        """What all folds but k have of class c, by k and c."""
        return [
            [sum((own(j, c) for j in range(folds) if j != k), F.lit(0)) for c in classes]
            for k in range(folds)
        ]

    def totals(rows: DataFrame) -> Column:
        sums = others(lambda k, c: F.coalesce(F.sum(f"n{k}_{c}"), F.lit(0)))
        return rows.agg(F.array(*[F.array(*per_class) for per_class in sums])).scalar()

    numbered = counts.sparkSession.range(spec.num_features).select(F.col("id").cast("int").alias("feature"))
    rest = others(lambda k, c: F.coalesce(F.col(f"n{k}_{c}"), F.lit(0)))
    logs = F.array(
        *[
            F.array(*[_log_share(rest[k][c], F.col("_sizes")[k][c] + spec.num_features) for c in classes])
            for k in range(folds)
        ]
    )
    weights = (
        numbered.join(counts, "feature", "left")
        .withColumn("_sizes", totals(counts.where(F.col("feature") != _ROWS)))
        .select("feature", logs.alias("logs"))
        .agg(F.sort_array(F.collect_list(F.struct("feature", "logs")))["logs"].alias("logs"))
    )

    def model(k: int) -> Column:
        rows = [F.col("_rows")[k][c] for c in classes]
        prior = F.array(*[_log_share(n, sum(rows) + spec.num_classes) for n in rows])
        return F.struct(prior.alias("prior"), F.transform("logs", lambda x: x[k]).alias("weights"))

    with_rows = weights.withColumn("_rows", totals(counts.where(F.col("feature") == _ROWS)))
    return with_rows.select(F.array(*[model(k) for k in range(folds)]).alias("models"))
