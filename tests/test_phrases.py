"""Phrase-level rewriting: the longest phrase counts, from left to right."""

import pytest

from corpusmith.operators.dictionary import PhraseLookup, phrase_rewrite, phrases_at, pivot_rewrite
from corpusmith.functions import text as tx
from pyspark.sql import functions as F

PHRASES = {
    "new": "fresh", "york": "jorvik", "new york": "big apple", "new york city": "gotham",
    "city": "town", "in": "within", "a b": "ab", "b c d": "bcd", "a": "one", "d": "four",
}


@pytest.fixture(scope="module", params=[None, 0], ids=["sent", "joined"])
def lookup(spark, request):
    forward = [("x", src, f"x:{src}") for src in PHRASES] + [("x", "far too long a phrase", "x:long")]
    forward += [("y", "new", "y:new"), ("x", "new", "x:zzz")]
    back = [("x", f"x:{src}", dst) for src, dst in PHRASES.items()] + [("y", "y:new", "neu"), ("x", "x:long", "no")]
    options = {} if request.param is None else {"broadcast_bytes": request.param}
    ddl = "lang string, src string, dst string"
    return PhraseLookup(spark.createDataFrame(forward, ddl), spark.createDataFrame(back, ddl), ("x", "y"), **options)


CASES = {
    "new york city": "gotham", "in new  york": "within big apple", "york new": "jorvik fresh",
    "new new york city city": "fresh gotham town", "a b": "ab", "a b c d": None,  # "a b" leaves "c", which no phrase has
    "a d": "one four", "": "", "  ": "", "unknown": None, None: None,
}


def test_longest_first(corpus, lookup):
    texts = list(CASES)
    rows = phrase_rewrite(corpus(texts), lookup, ["x"], "drop").collect()
    got = {r.ID: r.text for r in rows}
    assert got == {f"r{i}": CASES[t] for i, t in enumerate(texts) if CASES[t] is not None}
    assert all(r.aug_kind == "pivot_x" and r.row_key == f"{r.ID}#pivot_x" for r in rows)


def test_errors_keep_the_text(corpus, lookup):
    texts = list(CASES)
    rows = phrase_rewrite(corpus(texts), lookup).collect()
    assert len(rows) == 2 * len(texts)
    got = {r.row_key: r.text for r in rows}
    for i, t in enumerate(texts):
        assert got[f"r{i}#pivot_x"] == (t if CASES[t] is None else CASES[t])
        assert got[f"r{i}#pivot_y"] == ("" if t is not None and not t.strip() else t)
    with pytest.raises(ValueError):
        phrase_rewrite(corpus(texts), lookup, on_error="stop")


def test_single_tokens_are_rewritten_as_before(corpus, lookup):
    df = corpus(["new york", "city in york", "new b", None])
    one = {r.row_key: r.text for r in pivot_rewrite(df, lookup, ["x"]).collect()}
    assert one == {"r0#pivot_x": "fresh jorvik", "r1#pivot_x": "town within jorvik", "r2#pivot_x": "new b", "r3#pivot_x": None}


def test_phrases_at_each_place(corpus):
    rows = corpus(["p q r", "", None]).select(phrases_at(tx.tokens(F.col("text")), 2).alias("p")).collect()
    assert [r.p for r in rows] == [["p", "p q", "q", "q r", "r", None], [], None]
