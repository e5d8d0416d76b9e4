"""A quality classifier: logistic regression on hashed word n-grams.

Features of a text are its n-grams of words, for n up to ``order``, and the same
n-grams of word shapes (letters, capitals and digits as such, other signs as they
are; a word equal to the one before has a shape of its own). Each is hashed to
one of ``2 ** bits`` weights; the n-grams of one kind and length share a total
value of ``scale``, so a text's length does not matter.

Weights are learned with follow-the-regularised-leader (FTRL-proximal). At most
``sample`` labelled rows are used, those with the smallest hashes of their ids,
in ``shards`` independent runs whose weights are averaged; a run goes over its
rows ``passes`` times. So training has a fixed size, and a model is small enough
to be sent to every task. A score is a sparse dot product put through the
logistic function.

Null and empty texts have no features and get the score of the bias alone.
Labels that are null, or of ids that no row has, are left out; of several labels
of an id the largest counts. Without labels all scores are 0.5. Repeated rows get
equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.llm.common import per_document


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    order: int = 2
    scale: float = 8.0
    sample: int = 20_000
    shards: int = 8
    passes: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5


_SHAPES = bytes(
    97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
    for b in range(256)
)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def feature_groups(text: str, settings: Settings) -> Iterator[np.ndarray]:
    """Weight numbers of the n-grams, one array for each kind and length."""
    data = text.encode()
    words = data.split()
    if not words:
        return
    plain = _hashes(words, 0)
    shape_of: dict[bytes, int] = {}
    shapes = data.translate(_SHAPES).split()
    for shape in set(shapes):
        shape_of[shape] = xxhash.xxh3_64_intdigest(shape, 1)
    shaped = np.fromiter(map(shape_of.__getitem__, shapes), np.uint64, len(shapes))
    shaped[1:][plain[1:] == plain[:-1]] = np.uint64(1)
    for numbers in (plain, shaped):
        key = np.zeros(len(numbers), np.uint64)
        for n in range(settings.order):
            key = key[: len(numbers) - n] * _MULTIPLIER + numbers[n:]
            if len(key):
                mixed = (key ^ (key >> np.uint64(32))) * _MULTIPLIER
                yield (mixed >> np.uint64(64 - settings.bits)).astype(np.int64)


def sparse(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct weight numbers of a text and their values."""
    groups = list(feature_groups(text, settings))
    if not groups:
        return np.zeros(0, np.int64), np.zeros(0)
    values = [np.full(len(g), settings.scale / len(g)) for g in groups]
    numbers, inverse = np.unique(np.concatenate(groups), return_inverse=True)
    return numbers, np.bincount(inverse, np.concatenate(values), len(numbers))


class Ftrl:
    """Weights, learned example by example; the last one is the bias."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.z = np.zeros((1 << settings.bits) + 1)
        self.n = np.zeros((1 << settings.bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        s, z = self.settings, self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0.0)
        return -shrunk / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)

    def learn(self, numbers: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(numbers)
        p = logistic(float(w @ values))
        gradient = (p - label) * values
        before = self.n[numbers]
        after = before + gradient**2
        self.z[numbers] += gradient - (np.sqrt(after) - np.sqrt(before)) / self.settings.alpha * w
        self.n[numbers] = after


def logistic(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(x, -30.0), 30.0)))


def train_run(texts: list[str], labels: list[int], settings: Settings) -> np.ndarray:
    model, bias = Ftrl(settings), 1 << settings.bits
    examples = []
    for text in texts:
        numbers, values = sparse(text, settings)
        examples.append((np.append(numbers, bias), np.append(values, 1.0)))
    for _ in range(settings.passes):
        for (numbers, values), label in zip(examples, labels):
            model.learn(numbers, values, label)
    return model.weights(slice(None)).astype(np.float32)


def score(text: str, weights: np.ndarray, settings: Settings) -> float:
    total = float(weights[-1])
    for group in feature_groups(text, settings):
        total += settings.scale * float(weights[group].mean(dtype=np.float64))
    return float(logistic(total))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights from ``docs (doc_id, text)`` and ``labels (doc_id, label)``."""
    place = F.md5(F.col("doc_id").cast("string"))
    chosen = (
        labels.where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("label").cast("int").alias("label"))
        .orderBy(place, "doc_id")
        .limit(settings.sample)
    )
    texts = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    # ``chosen`` has at most ``sample`` rows of two numbers; of rows with one id, one text
    # is learned, so no group has more rows than ids
    text = F.struct(F.xxhash64("text").alias("h"), "text")
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min(text)["text"].alias("text"), F.max("label").alias("label")
    )
    rows = one.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(settings.shards)).alias("shard"),
        place.alias("place"),
        "text",
        "label",
    )

    def run(group: pa.Table) -> pa.Table:
        ordered = group.sort_by([("place", "ascending"), ("text", "ascending")])
        weights = train_run(
            ordered.column("text").to_pylist(), ordered.column("label").to_pylist(), settings
        )
        used = np.flatnonzero(weights)
        return pa.table(
            {
                "n": pa.array([group.num_rows], pa.int64()),
                "used": pa.array([used.astype("<i8").tobytes()], pa.binary()),
                "weights": pa.array([weights[used].tobytes()], pa.binary()),
            }
        )

    runs = rows.groupBy("shard").applyInArrow(run, "n long, used binary, weights binary")
    # As many rows as shards, each of 2 ** bits weights at most. Put in order here,
    # as a global sort in Spark would train everything twice, once to sample keys.
    models = sorted(runs.collect(), key=lambda m: (m.n, m.used, m.weights))
    total = np.zeros((1 << settings.bits) + 1)
    for m in models:
        total[np.frombuffer(m.used, "<i8")] += m.n * np.frombuffer(m.weights, np.float32)
    return (total / max(1, sum(m.n for m in models))).astype(np.float32)


def score_documents(docs: DataFrame, weights: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, score)``: one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = shared.value
        return lambda texts: [
            pa.array([score(x.as_py(), w, settings) for x in texts], pa.float64())
        ]

    return per_document(docs, make, "score double")


def held_out(doc_id: Column) -> Column:
    """A third of all ids, never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
