"""Several naive Bayes models split a text into tokens once."""

import pytest

from corpusmith.functions import text as tx
from corpusmith.operators import bayes, models
from corpusmith.operators.bayes import BayesSpec

TEXTS = ["red red apple", "green apple", "blue sea sea", "blue  sky", None, "", "one", "red sea apple sky"]
SPECS = [BayesSpec(n, num_features=64, num_classes=2) for n in (1, 2, 3)]


@pytest.fixture
def made(monkeypatch):
    calls = []
    monkeypatch.setattr(bayes, "tokens", lambda text: calls.append(1) or tx.tokens(text))
    return calls


def test_ensemble_tokenizes_once(corpus, made):
    df = corpus(TEXTS, [0, 0, 1, 1, 1, 0, 0, 1])
    fitted = models.train_ensemble(df, SPECS)
    del made[:]
    relabelled = models.relabel_ensemble(df, fitted)
    assert len(made) == 1
    assert relabelled.columns == df.columns
    raws = [{r.row_key: r.raw for r in models.score(df, m).collect()} for m in fitted]
    for row in relabelled.collect():
        mean = [sum(x) for x in zip(*(r[row.row_key] for r in raws))]
        assert row.target == mean.index(max(mean))


def test_cross_validation_tokenizes_once_for_each_pass(corpus, made):
    model, f1 = models.cross_validated(corpus(TEXTS, [0, 0, 1, 1, 1, 0, 0, 1]), SPECS, folds=2)
    assert len(made) == 2 and model.spec in SPECS and 0 <= f1 <= 1


def test_grams_of_short_texts(corpus):
    df = corpus(TEXTS)
    sizes = [[len(r[0]) for r in df.select(bayes.features(s)).collect()] for s in SPECS]
    assert sizes == [[3, 2, 3, 2, 0, 0, 1, 4], [2, 1, 2, 1, 0, 0, 0, 3], [1, 0, 1, 0, 0, 0, 0, 2]]
