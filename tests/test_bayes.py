"""Naive Bayes against counts by hand, and its edge cases."""

import hashlib
import math
from collections import Counter

import pytest

from corpusmith.operators import models
from corpusmith.operators.bayes import BayesSpec, fold_number, train_bayes, train_folds

TEXTS = ["red red apple", "green apple", "blue sea sea", "blue sky", None, "", "red sea apple sky"]
TARGETS = [0, 0, 1, 1, 1, 0, None]


def expected(texts, targets, text, spec):
    """Log scores of one text, in millionths."""

    def features(t):
        toks = (t or "").split()
        grams = [" ".join(toks[i : i + spec.ngram]) for i in range(len(toks) - spec.ngram + 1)]
        return [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % spec.num_features for g in grams]

    known = [(features(t), c) for t, c in zip(texts, targets) if c is not None]
    scores = []
    for c in range(spec.num_classes):
        seen = Counter(f for fs, label in known if label == c for f in fs)
        size = seen.total() + spec.num_features
        rows = sum(label == c for _, label in known)
        total = round(1e6 * math.log((rows + 1) / (len(known) + spec.num_classes)))
        scores.append(total + sum(round(1e6 * math.log((seen[f] + 1) / size)) for f in features(text)))
    return scores


@pytest.mark.parametrize("ngram", [1, 2])
def test_scores_are_those_of_the_counts(corpus, ngram):
    spec = BayesSpec(ngram, num_features=64, num_classes=3)
    df = corpus(TEXTS, TARGETS)
    scored = models.score(df, models.train(df, spec)).collect()
    assert len(scored) == len(TEXTS)
    for row in scored:
        want = expected(TEXTS, TARGETS, row.text, spec)
        assert [round(x * 1e6) for x in row.raw] == want
        assert sum(row.probs) == pytest.approx(1.0)


def test_predicts_what_it_has_seen(corpus):
    df = corpus(TEXTS, TARGETS)
    model = models.train(df, BayesSpec(num_features=64, num_classes=2))
    told = {r.text: r.target for r in models.predict(df, model).collect()}
    assert told["red red apple"] == 0 and told["blue sea sea"] == 1


def test_without_labels_all_classes_are_equal(corpus):
    spec = BayesSpec(num_features=64, num_classes=2)
    nothing = corpus(TEXTS).where("false")
    model = train_bayes(nothing, spec)
    assert models.score(nothing, model).count() == 0
    assert all(r.probs == [0.5, 0.5] for r in models.score(corpus(TEXTS), model).collect())


def test_targets_out_of_range_train_nothing(corpus):
    spec = BayesSpec(num_features=64, num_classes=2)
    some = train_bayes(corpus(TEXTS[:4], [0, 1, 7, -1]), spec).table.head()
    assert some == train_bayes(corpus(TEXTS[:2], [0, 1]), spec).table.head()


def test_other_columns_and_repeated_rows_stay(corpus):
    df = corpus(TEXTS, TARGETS).selectExpr("*", "1 AS prior", "2 AS weights")
    twice = df.unionByName(df)
    model = models.train(df, BayesSpec(num_features=64, num_classes=2))
    scored = models.score(twice, model)
    assert scored.columns == [*df.columns, "probs", "raw"]
    assert scored.count() == 2 * len(TEXTS)


def test_size_is_bounded():
    with pytest.raises(ValueError):
        BayesSpec(num_features=1 << 20, num_classes=2)


def test_best_of_several_specs(corpus):
    df = corpus(TEXTS, TARGETS).where("target is not null")
    specs = [BayesSpec(n, num_features=64, num_classes=2) for n in (2, 1)]
    model, f1 = models.train_best(df, df, specs)
    assert f1 == max(models.evaluate(df, models.train(df, s)).head()[0] for s in specs)
    assert model.spec in specs


def test_fold_models_are_trained_on_the_other_folds(corpus):
    texts, targets = TEXTS * 6, [t if t is not None else 5 for t in TARGETS * 6]
    specs = [BayesSpec(1, 64, 3), BayesSpec(2, 32, 3)]
    df = corpus(texts, targets)
    rows = df.select("*", fold_number(3).alias("fold")).collect()
    assert {r.fold for r in rows} == {0, 1, 2}
    for spec, model in zip(specs, train_folds(df, specs, 3)):
        assert model.spec == spec
        scored = {r.row_key: r for r in models.score(df, model).collect()}
        for row in rows:
            rest = [r for r in rows if r.fold != row.fold]
            labels = [r.target if r.target < 3 else None for r in rest]
            want = expected([r.text for r in rest], labels, row.text, spec)
            assert [round(x * 1e6) for x in scored[row.row_key].raw] == want
            assert sum(scored[row.row_key].probs) == pytest.approx(1.0)


def test_cross_validation_takes_the_better_specification(corpus):
    # the order of two words says the class, single words don't
    texts, targets = ["up down", "down up"] * 40, [0, 1] * 40
    df = corpus(texts, targets)
    specs = [BayesSpec(1, 64, 2), BayesSpec(2, 64, 2)]
    model, f1 = models.cross_validated(df, specs, 4)
    assert model.spec == specs[1] and f1 == 1.0
    assert all(r.target == (r.text == "down up") for r in models.predict(df, model).collect())
    # of equal ones the first, and without labelled rows too
    assert models.cross_validated(df, [specs[1], specs[1]], 2)[0].spec is specs[1]
    model, f1 = models.cross_validated(df.where("false"), specs, 2)
    assert model.spec == specs[0] and f1 == 0.0


def test_fold_bounds(corpus):
    df = corpus(TEXTS, TARGETS)
    with pytest.raises(ValueError):
        train_folds(df, [BayesSpec(1, 64, 2), BayesSpec(1, 64, 3)], 3)
    with pytest.raises(ValueError):
        train_folds(df, [BayesSpec(1, 1 << 16, 7)], 5)
    with pytest.raises(ValueError):
        train_folds(df, [BayesSpec(1, 64, 2)], 1)
