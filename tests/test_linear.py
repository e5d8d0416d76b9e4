"""Linear models trained together, against plain gradient descent row by row."""

import hashlib
import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusmith.operators import linear
from corpusmith.operators.linear import LOSSES, LinearSpec, train_linear

TEXTS = ["red red apple", "green apple", "blue sea sea", "blue sky", None, "", "red sea apple sky", "sky sky red"]
TARGETS = [0, 0, 1, 1, 1, 0, None, 2]


def slope(loss, scores, c, target):
    y, s = float(target == c), scores[c]
    if loss == "softmax":
        top = max(scores)
        return math.exp(s - top) / sum(math.exp(x - top) for x in scores) - y
    if loss == "logistic":
        return 1 / (1 + math.exp(-s)) - y
    sign = 2 * y - 1
    return -sign * max(0.0, 1 - sign * s) if loss == "hinge" else s - sign


def descend(texts, targets, spec, loss):
    """Weights by feature, and the scores of a text."""

    def found(text):
        return [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % spec.num_features for t in (text or "").split()]

    weights = {}
    step = spec.rate / (2 * {"softmax": 0.5, "logistic": 0.25, "hinge": 1, "squares": 1}[loss])

    def norm(own):
        return math.sqrt(sum(n * n for n in Counter(own).values())) or 1.0

    def scores(text):
        own = found(text)
        return [
            (weights.get((-1, c), 0) + sum(weights.get((f, c), 0) for f in own) / norm(own)) / 1e6
            for c in range(spec.num_classes)
        ]

    known = [(t, c) for t, c in zip(texts, targets) if c is not None and 0 <= c < spec.num_classes]
    for _ in range(spec.iterations):
        sums = {}
        for text, target in known:
            own, s = found(text), scores(text)
            for c in range(spec.num_classes):
                g = slope(loss, s, c, target)
                sums[-1, c] = sums.get((-1, c), 0) + math.floor(g * 1e6 + 0.5)
                for f in own:
                    sums[f, c] = sums.get((f, c), 0) + math.floor(g * 1e6 / norm(own) + 0.5)
        for key in {*sums, *weights}:
            old, g = weights.get(key, 0), sums.get(key, 0)
            weights[key] = math.floor(old * (1.0 - step * spec.decay) - g * step / len(known) + 0.5)
    total = sum(math.floor(abs(x) * 1e6 + 0.5) for t, _ in known for x in scores(t))
    return scores, total / (1e6 * len(known) * spec.num_classes)


@pytest.fixture(scope="module")
def spec():
    return LinearSpec(num_features=64, num_classes=3, iterations=4, decay=0.01)


def test_all_models_are_those_of_their_own_descent(corpus, spec):
    df = corpus(TEXTS, TARGETS)
    models = train_linear(df.repartition(3), spec)
    rows = models.score(df).collect()
    assert len(rows) == len(TEXTS)
    for m, loss in enumerate(spec.losses):
        scores, scale = descend(TEXTS, TARGETS, spec, loss)
        assert models.scales[m] == pytest.approx(scale)
        for row in rows:
            assert row.raws[m] == pytest.approx([s / scale for s in scores(row.text)])


def test_partitions_change_nothing(corpus, spec):
    df = corpus(TEXTS * 20, TARGETS * 20)
    first, second = (train_linear(df.repartition(n), spec) for n in (1, 7))
    assert (first.weights == second.weights).all() and first.scales == second.scales


def test_one_scale_and_predictions(corpus):
    spec = LinearSpec(num_features=64, num_classes=3, iterations=60)
    df = corpus(TEXTS, TARGETS)
    models = train_linear(df, spec)
    rows = models.score(df.where("target is not null")).collect()
    means = np.abs([r.raws for r in rows]).mean(axis=(0, 2))
    assert means == pytest.approx(np.ones(4), abs=1e-5)
    for model in (None, 0, 1, 2, 3):
        told = {r.text: r.target for r in models.predict(df, model=model).collect()}
        assert (told["red red apple"], told["blue sea sea"], told["sky sky red"]) == (0, 1, 2)
        assert models.predict(df, model=model).columns == ["row_key", "ID", "text", "target"]


def test_without_labels(corpus, spec):
    models = train_linear(corpus(TEXTS).where("false"), spec)
    assert not models.weights.any() and models.scales == (1.0,) * 4
    assert {r.target for r in models.predict(corpus(TEXTS)).collect()} == {0}


def test_one_pass_per_iteration(corpus, spec, spark):
    context = spark.sparkContext
    df = corpus(TEXTS, TARGETS)
    jobs = []
    for iterations in (2, 6):
        context.setJobGroup(f"descent-{iterations}", "descent")
        train_linear(df, LinearSpec(num_features=64, num_classes=3, iterations=iterations))
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"descent-{iterations}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    # a step is one query: the shuffle of its gradients and their collection
    assert jobs[1] - jobs[0] <= 4 * 2


def test_bounds():
    assert set(LOSSES) == {"softmax", "logistic", "hinge", "squares"}
    with pytest.raises(ValueError):
        LinearSpec(losses=("softmax", "cubes"))
    with pytest.raises(ValueError):
        LinearSpec(num_features=1 << 20)


def test_memory_does_not_grow_with_a_batch():
    """What a task holds beside its batch is bounded, however many texts are in that."""
    spec = LinearSpec(num_features=4096, num_classes=4)
    n_rows, n_tokens = 4000, 400
    numbers = np.random.default_rng(1).integers(0, 4096, n_rows * n_tokens, dtype=np.int32)
    found = pa.ListArray.from_arrays(np.arange(0, len(numbers) + 1, n_tokens, dtype=np.int32), pa.array(numbers))
    target = pa.array(np.arange(n_rows, dtype=np.int32) % 4)
    whole = pa.RecordBatch.from_arrays([target, found], ["target", "found"])
    weights = np.random.default_rng(2).integers(-9, 9, (4097, 4, 4))
    tracemalloc.start()
    (sums,) = linear._gradient_rows(spec, weights)(iter([whole]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20
    (parts,) = linear._gradient_rows(spec, weights)(whole.slice(i, 500) for i in range(0, n_rows, 500))
    assert sums == parts
