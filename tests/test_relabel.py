"""Relabelling and metrics against brute force in numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmith.operators import metrics, models, relabel
from corpusmith.operators.models import TextModelSpec


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def brute_force_issues(keys, labels, probs, num_classes):
    p = np.floor(np.array(probs) * 1e6 + 0.5).astype(int)
    labels = np.array(labels)
    thresholds = [p[labels == c, c].mean() if (labels == c).any() else None for c in range(num_classes)]
    guess = []
    for row in p:
        over = [(-row[c], c) for c in range(num_classes) if thresholds[c] is not None and row[c] >= thresholds[c]]
        guess.append(min(over)[1] if over else None)
    flagged = set()
    for i in range(num_classes):
        counts = [sum(1 for g, y in zip(guess, labels) if y == i and g == j) for j in range(num_classes)]
        total, size = sum(counts), int((labels == i).sum())
        for j in range(num_classes):
            if i == j or total == 0:
                continue
            wanted = (2 * counts[j] * size + total) // (2 * total)
            order = sorted(
                (r for r in range(len(keys)) if labels[r] == i),
                key=lambda r: (p[r, i] - p[r, j], md5(relabel.RANK_SEED, keys[r]), keys[r]),
            )
            flagged |= set(order[:wanted])
    best = p.argmax(axis=1)
    flagged = [r for r in flagged if best[r] != labels[r]]
    flagged.sort(key=lambda r: (p[r, labels[r]], md5(relabel.RANK_SEED, keys[r]), keys[r]))
    return [(keys[r], int(best[r])) for r in flagged]


@pytest.mark.parametrize("seed,num_classes,hot", [(1, 3, False), (2, 5, True), (3, 7, True)])
def test_label_issues_match_brute_force(spark, seed, num_classes, hot):
    rng = np.random.default_rng(seed)
    n = 600
    labels = rng.integers(0, num_classes - 1, n)  # the last class has no rows
    if hot:
        labels[: n // 3] = 0
    probs = rng.dirichlet(np.ones(num_classes) * 0.7, n)
    probs[np.arange(n), labels] += rng.random(n) * 0.4
    probs = probs / probs.sum(axis=1, keepdims=True)
    # ties: a third of the rows are copies of one score vector
    probs[: n // 3] = probs[0]
    probs = np.round(probs, 6)
    keys = [f"k{i}" for i in range(n)]
    rows = [(k, int(y), [float(x) for x in p]) for k, y, p in zip(keys, labels, probs)]
    scored = spark.createDataFrame(rows, "row_key string, target int, probs array<double>")
    flagged = relabel.flag_issues(scored, num_classes)
    issues = relabel.label_issues(flagged).orderBy("rank").collect()
    expected = brute_force_issues(keys, labels, probs, num_classes)
    assert [(r.row_key, r.suggested) for r in issues] == expected
    assert [r["rank"] for r in issues] == list(range(1, len(expected) + 1))
    new = dict(expected)
    corrected = flagged.withColumn("target", relabel.corrected_target())
    by_key = relabel.apply_corrections(scored, relabel.label_issues(flagged))
    for frame in (corrected, by_key):
        got = {r.row_key: r.target for r in frame.collect()}
        assert got == {k: new.get(k, int(y)) for k, y in zip(keys, labels)}


def test_no_issues_returns_the_input(spark):
    scored = spark.createDataFrame(
        [("a", 0, [0.9, 0.1]), ("b", 1, [0.2, 0.8])],
        "row_key string, target int, probs array<double>",
    )
    flagged = relabel.flag_issues(scored, 2)
    assert relabel.label_issues(flagged).count() == 0
    kept = flagged.select("row_key", relabel.corrected_target().alias("t")).collect()
    assert {r.row_key: r.t for r in kept} == {"a": 0, "b": 1}


def test_ensemble_averages_raw_scores(spark):
    # the mean of probabilities would pick class 1 here
    df = spark.createDataFrame(
        [([9.0, 0.0], [0.0, 2.0], [0.0, 2.0]), ([1.0, 1.0], [0.0, 0.0], [2.0, 2.0])],
        "a array<double>, b array<double>, c array<double>",
    )
    label = relabel.ensemble_label([F.col("a"), F.col("b"), F.col("c")])
    assert [r[0] for r in df.select(label).collect()] == [0, 0]  # first on ties


@pytest.mark.parametrize("pairs", [
    [(0, 0), (0, 1), (1, 1), (2, 0), (2, 2), (2, 2)],
    [(0, 1), (1, 0)],
    [(0, 0), (1, 3), (1, 1)],  # 3 occurs only as a prediction
])
def test_macro_f1(spark, pairs):
    df = spark.createDataFrame(pairs, "target int, prediction int")
    classes = sorted({c for pair in pairs for c in pair})
    f1 = []
    for c in classes:
        tp = sum(1 for y, p in pairs if y == p == c)
        wrong = sum(1 for y, p in pairs if (y == c) != (p == c))
        f1.append(2 * tp / (2 * tp + wrong))
    assert metrics.macro_f1(df).head()[0] == pytest.approx(np.mean(f1))
    per_class = {r["class"]: r.f1 for r in metrics.class_f1(df).collect()}
    assert per_class == pytest.approx(dict(zip(classes, f1)))


def test_models_learn_and_relabel(spark):
    words = {0: "ball goal team", 1: "bank stock price", 2: "vote party law"}
    rows = [(f"k{i}", f"{words[i % 3]} filler{i % 11}", i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "row_key string, text string, target int")
    spec = TextModelSpec(num_features=512, max_iter=10, num_classes=4)
    model = models.train(df, spec)
    assert models.evaluate(df, model).head()[0] == pytest.approx(1.0)
    scored = models.score(df, model).head()
    assert len(scored.probs) == 4 and sum(scored.probs) == pytest.approx(1.0)
    wrong = df.withColumn("target", (F.col("target") + 1) % 3)
    chars = TextModelSpec("char", 2, num_features=512, max_iter=10, num_classes=4, idf=True)
    for relabelled in (
        models.relabel_all(wrong, model),
        models.relabel_ensemble(wrong, [model, models.train(df, chars)]),
    ):
        assert relabelled.columns == df.columns
        assert relabelled.exceptAll(df).isEmpty()
    best, f1 = models.train_best(df, df, [spec, TextModelSpec(num_features=1, num_classes=4)])
    assert f1 == pytest.approx(1.0)


def test_missing_labels_and_predictions(spark):
    rows = [(0, 0), (1, 1), (None, 0), (1, None)]
    df = spark.createDataFrame(rows, "target int, prediction int")
    # the row without a label is left out, the one without a prediction is a miss of 1
    assert metrics.macro_f1(df).head()[0] == pytest.approx((1 + 2 / 3) / 2)


def test_repeated_suggestions_leave_one_row(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1)], "row_key string, target int")
    issues = spark.createDataFrame([("a", 3), ("a", 2)], "row_key string, suggested int")
    assert sorted(map(tuple, relabel.apply_corrections(df, issues).collect())) == [("a", 2), ("b", 1)]


def test_rows_without_a_label_take_the_suggestion(spark):
    rows = [(None, 2, None), (None, 0, False), (1, 2, False), (1, 2, True)]
    flagged = spark.createDataFrame(rows, "target int, suggested int, is_issue boolean")
    corrected = flagged.select(relabel.corrected_target().alias("target")).collect()
    assert [r["target"] for r in corrected] == [2, 0, 1, 2]
