"""Corrections of unknown tokens against all edit distances."""

import random
from itertools import product

import pytest

from pyspark.sql import functions as F

from corpusmith.operators import dictionary, spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def nearest(unknown, known, max_edits):
    out = set()
    for token in {u for u in unknown if u is not None and u not in known}:
        found = [(distance(token, k), -n, k) for k, n in known.items()]
        found = [f for f in found if f[0] <= max_edits]
        if found:
            d, _, best = min(found)
            out.add((token, best, d))
    return out


@pytest.mark.parametrize("max_edits,prefix", [(1, 4), (2, 5), (2, 8), (3, 6)])
def test_nearest_known_token(spark, max_edits, prefix):
    chance = random.Random(max_edits * 10 + prefix)
    word = lambda: "".join(chance.choice("abcé") for _ in range(chance.randint(0, 9)))
    known = {word(): chance.randint(1, 5) for _ in range(120)}
    unknown = [word() for _ in range(200)] + ["", None, *list(known)[:5]]
    got = spelling.spelling_corrections(
        spark.createDataFrame([(u,) for u in unknown], "token string"),
        spark.createDataFrame([*known.items(), (None, 9)], "token string, n long"),
        max_edits,
        prefix,
    )
    assert {tuple(r) for r in got.collect()} == nearest(unknown, known, max_edits)


def test_every_edit_near_the_start_of_long_words_is_found(spark):
    """Shifts by insertion move characters out of the prefix."""
    base = "abcdefghijkl"
    edits = {x + base for x in "xyz"} | {base[1:], base[2:], "xy" + base, base[:3] + "x" + base[4:]}
    edits |= {a + base[1:] + b for a, b in product(["x", ""], ["y", ""])}
    unknown = spark.createDataFrame([(e,) for e in edits - {base}], "token string")
    known = spark.createDataFrame([(base, 1)], "token string, n long")
    for prefix in (3, 5, 12):
        got = spelling.spelling_corrections(unknown, known, 2, prefix).collect()
        assert {r.token: r.distance for r in got} == {e: distance(e, base) for e in edits - {base}}


def test_counts_and_texts(corpus, spark):
    df = corpus(["the house  the", "teh huose\n", None, "", "xyzzy the"])
    counts = {r.token: r.n for r in spelling.token_counts(df).collect()}
    assert counts == {"the": 3, "house": 1, "teh": 1, "huose": 1, "xyzzy": 1}
    known = spark.createDataFrame([("the", 3), ("house", 1)], "token string, n long")
    found = spelling.spelling_corrections(spelling.token_counts(df), known)
    fixed = dictionary.correct_tokens(df, found.select("token", "correction"))
    texts = {r.ID: r.text for r in fixed.collect()}
    assert texts == {"r0": "the house  the", "r1": "the house\n", "r2": None, "r3": "", "r4": "xyzzy the"}
    assert spelling.spelling_corrections(found.select("token"), known.where("false")).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_corrections(counts, known, 2, 2)


def test_neighbourhoods_are_spread_and_never_broadcast(spark):
    """Small tables of tokens have many neighbours: not for the driver, nor for one task."""
    words = spark.range(400).select(F.substring(F.md5(F.col("id").cast("string")), 1, 9).alias("token"))
    known = words.select(F.concat(F.lit("x"), F.substring("token", 2, 8)).alias("token"), F.lit(1).alias("n"))
    found = spelling.spelling_corrections(words, known)
    assert found.count() == 400
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    parts = 4 * spark.sparkContext.defaultParallelism
    assert plan.count("hashpartitioning(key") >= 2
    assert f", {parts}), REPARTITION_BY_NUM" in plan


def test_letters_change_by_one_bit_at_most_per_character(spark):
    words = ["", "a", "aa", "aaa", "abca", "é", "aé", "!a", "𝄞a", "zebra"]
    rows = [(w, w[:i] + w[i + 1 :]) for w in words for i in range(len(w))]
    both = spark.createDataFrame(rows, "longer string, shorter string")
    bits = [spelling.letters(F.col(c)) for c in ("longer", "shorter")]
    assert {r[0] <= 1 for r in both.select(F.bit_count(bits[0].bitwiseXOR(bits[1]))).collect()} == {True}
