"""Several linear classifiers, trained together on shared features.

All models see the same hashed n-grams of a text, as a vector of length 1 and a constant,
and differ in their loss. An iteration of full-batch gradient descent is one pass over
the rows for all of them: each task adds up the gradients of its rows in one dense
array of bounded size, and Spark adds up the tasks' arrays by feature.

Weights and scores are whole millionths and each row's part of a gradient is
rounded to millionths before it is added, so sums are exact and a model does not
depend on partitioning, on the order of rows or on repeated tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.functions.arrow import bounded_runs, map_column
from corpusmith.functions.columns import argmax
from corpusmith.operators.bayes import MAX_WEIGHTS, BayesSpec, features
from corpusmith.sources.staging import stage

MICRO = 1_000_000
# a task looks at so many weights at once (8 bytes each), or at those of one text
CELLS = 1 << 20

# what each loss makes of scores ``s`` and labels ``y`` (0 or 1), both rows x classes:
# the derivative by the score
LOSSES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {}
# the largest second derivative of each loss
CURVATURE: dict[str, float] = {}


def loss(curvature: float) -> Callable:
    def named(function: Callable) -> Callable:
        LOSSES[function.__name__] = function
        CURVATURE[function.__name__] = curvature
        return function

    return named


@loss(0.5)
def softmax(s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Multinomial logistic regression."""
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True) - y


@loss(0.25)
def logistic(s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One logistic regression per class."""
    return 1.0 / (1.0 + np.exp(-s)) - y


@loss(1.0)
def hinge(s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One support vector machine per class, with squared hinge loss."""
    sign = 2.0 * y - 1.0
    return -sign * np.maximum(0.0, 1.0 - sign * s)


@loss(1.0)
def squares(s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares towards +1 and -1, one per class."""
    return s - (2.0 * y - 1.0)


@dataclass(frozen=True)
class LinearSpec:
    """Shared features, and the losses of the models that see them.

    ``rate`` is the step in units of what each loss's curvature allows; with 1 no step
    makes the loss larger. ``decay`` is the share of a weight that a unit step takes.
    """

    losses: tuple[str, ...] = ("softmax", "logistic", "hinge", "squares")
    ngram: int = 1
    num_features: int = 1 << 12
    num_classes: int = 7
    iterations: int = 20
    rate: float = 1.0
    decay: float = 0.0

    def __post_init__(self):
        if unknown := set(self.losses) - set(LOSSES):
            raise ValueError(f"unknown losses: {sorted(unknown)}")
        if (self.num_features + 1) * len(self.losses) * self.num_classes > MAX_WEIGHTS:
            raise ValueError(f"the models hold at most {MAX_WEIGHTS} numbers together")

    def step(self, name: str) -> float:
        # the features and the constant add up to a squared length of 2
        return self.rate / (2.0 * CURVATURE[name])

    @property
    def shared(self) -> BayesSpec:
        return BayesSpec(self.ngram, self.num_features, self.num_classes)


@dataclass(frozen=True)
class LinearModels:
    """``weights[feature, model, class]`` in millionths, the last feature being the
    constant; ``scales`` are the models' mean absolute scores on what they learned."""

    spec: LinearSpec
    weights: np.ndarray = field(repr=False)
    scales: tuple[float, ...]

    def score(self, df: DataFrame, output: str = "raws") -> DataFrame:
        """Add ``output``, per model an array of class scores in units of its scale."""
        weights, scales = self.weights, np.array(self.scales)[None, :, None]

        def raws(found: pa.Array) -> pa.Array:
            scores = []
            for start, stop in _parts(found, weights):
                flat, sizes = _flat(found[start:stop])
                scores += (_scores(flat, sizes, _norms(flat, sizes), weights) / scales).tolist()
            return pa.array(scores, pa.list_(pa.list_(pa.float64())))

        kind = T.ArrayType(T.ArrayType(T.DoubleType()))
        return map_column(df, features(self.spec.shared), output, kind, raws)

    def predict(self, df: DataFrame, output: str = "target", model: int | None = None) -> DataFrame:
        """Write the class with the best score: of one model, or of the mean of all,
        which their common scale allows."""
        per_class = range(self.spec.num_classes)
        which = range(len(self.spec.losses)) if model is None else [model]
        mean = F.array(*[sum((F.col("_raws")[m][c] for m in which), F.lit(0.0)) for c in per_class])
        keep = [F.col(c) for c in df.columns if c != output]
        return self.score(df, "_raws").select(*keep, argmax(F.transform(mean, lambda x: F.round(x, 9))).alias(output))


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5).astype(np.int64)


def _parts(found: pa.Array, weights: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of rows whose features have at most ``CELLS`` weights in all. A batch of
    many texts has hundreds of megabytes of them."""
    sizes = pc.list_value_length(found).to_pylist()
    return bounded_runs(sizes, CELLS // int(np.prod(weights.shape[1:])))


def _flat(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return found.flatten().to_numpy().astype(np.int64), pc.list_value_length(found).to_numpy().astype(np.int64)


def _norms(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The length of each row's vector of feature counts; 1 without features."""
    if not len(flat):
        return np.ones(len(sizes))
    span = int(flat.max()) + 1
    cells, counts = np.unique(np.repeat(np.arange(len(sizes)) * span, sizes) + flat, return_counts=True)
    squares_ = np.bincount(cells // span, counts.astype(float) ** 2, len(sizes))
    return np.sqrt(np.where(sizes > 0, squares_, 1.0))


def _scores(flat: np.ndarray, sizes: np.ndarray, norms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows x models x classes: the constant and the weights of the features."""
    sums = np.zeros((len(sizes), *weights.shape[1:]), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        sums[some] = np.add.reduceat(weights[flat], starts, axis=0)
    return (weights[-1] + sums / norms[:, None, None]) / MICRO


def _add_gradients(
    sums: np.ndarray, spec: LinearSpec, weights: np.ndarray, found: pa.Array, target: np.ndarray
) -> None:
    flat, sizes = _flat(found)
    norms = _norms(flat, sizes)
    scores = _scores(flat, sizes, norms, weights)
    y = np.eye(spec.num_classes)[target]
    sums[-1, :, 0] += _rounded(np.abs(scores) * MICRO).sum(axis=(0, 2))
    sums[-1, :, 1] += len(sizes)
    for m, name in enumerate(spec.losses):
        slope = LOSSES[name](scores[:, m], y)
        sums[-2, m] += _rounded(slope * MICRO).sum(axis=0)
        shares = _rounded(slope * MICRO / norms[:, None])
        for c in range(spec.num_classes):
            # whole numbers below 2 ** 53 in each part, so the sums are exact
            own = np.bincount(flat, np.repeat(shares[:, c], sizes), spec.num_features)
            sums[:-2, m, c] += own.astype(np.int64)


def _gradient_rows(spec: LinearSpec, weights: np.ndarray) -> Callable:
    """One row per feature of a task's gradients; row ``num_features`` is that of the
    constant, and a last one has the sums of absolute scores and the rows."""
    shape = (len(spec.losses), spec.num_classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((spec.num_features + 2, *shape), np.int64)
        for batch in batches:
            found, target = batch.column("found"), batch.column("target").to_numpy()
            for start, stop in _parts(found, weights):
                _add_gradients(sums, spec, weights, found[start:stop], target[start:stop])
        some = np.flatnonzero(sums.any(axis=(1, 2)))
        rows = sums[some].reshape(len(some), spec.num_classes * len(spec.losses))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), *[pa.array(rows[:, i]) for i in range(rows.shape[1])]],
            ["feature", *[f"g{i}" for i in range(rows.shape[1])]],
        )

    return run


def _pass(rows: DataFrame, spec: LinearSpec, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradients, sums of absolute scores by model, and the number of rows."""
    names = [f"g{i}" for i in range(len(spec.losses) * spec.num_classes)]
    schema = ", ".join(["feature int", *[f"{n} long" for n in names]])
    parts = rows.mapInArrow(_gradient_rows(spec, weights), schema)
    sums = np.zeros((spec.num_features + 2, len(spec.losses), spec.num_classes), np.int64)
    # at most num_features + 2 rows
    for feature, *values in parts.groupBy("feature").agg(*[F.sum(n) for n in names]).collect():
        sums[feature] = np.reshape(values, sums.shape[1:])
    return sums[:-1], sums[-1, :, 0], int(sums[-1, 0, 1])


def train_linear(df: DataFrame, spec: LinearSpec = LinearSpec()) -> LinearModels:
    """Train all models of ``spec`` on ``text`` and ``target``; one pass per iteration.

    Rows without a target, or with one outside 0..num_classes-1, are left out; a
    null text counts as empty. Without any rows all scores are 0.
    """
    known = df.where(F.col("target").between(0, spec.num_classes - 1))
    rows = stage(known.select(F.col("target").cast("int"), features(spec.shared).alias("found")), "linear")
    weights = np.zeros((spec.num_features + 1, len(spec.losses), spec.num_classes), np.int64)
    steps = np.array([spec.step(name) for name in spec.losses])[:, None]
    for _ in range(spec.iterations):
        gradient, _, n = _pass(rows, spec, weights)
        if not n:
            break
        weights = _rounded(weights * (1.0 - steps * spec.decay) - gradient * steps / n)
    _, total, n = _pass(rows, spec, weights)
    scales = [int(t) / (MICRO * n * spec.num_classes) if n and t else 1.0 for t in total]
    return LinearModels(spec, weights, tuple(scales))
