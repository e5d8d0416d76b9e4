"""Augmentation against brute force in Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmith.operators import dictionary as di
from corpusmith.operators.augment import augment, naive_augment, noise_filtering
from corpusmith.operators.eda import ALL_OPS, EDA_SEED, NOTEBOOK_OPS, SynonymLookup, eda_augment
from corpusmith.operators.models import score_batches
from corpusmith.profiles import KOREAN

TEXTS = [
    "one two three four five six seven eight nine ten eleven twelve",
    "alpha beta  gamma\tdelta",
    "single",
    "",
    "   ",
    None,
    " ".join(f"w{i % 17}" for i in range(250)),
]
SYNONYMS = {"one": ["uno", "eins"], "three": ["tri"], "beta": ["b", "bb", "bbb"],
            **{f"w{i}": [f"x{i}", f"y{i}"] for i in range(0, 17, 3)}}


def h(*parts):
    return hashlib.md5("|".join(map(str, (EDA_SEED, *parts))).encode()).hexdigest()


def u32(digest):
    return int(digest[:8], 16)


def py_eda(op, key, text):
    if text is None or op == "original":
        return text
    tokens = text.split()
    n = len(tokens)
    k = max(1, int(0.1 * n))
    if op == "delete":
        drawn = [(h("delete", key, i), t) for i, t in enumerate(tokens)]
        kept = [t for d, t in drawn if u32(d) / 2**32 >= 0.1]
        return " ".join(kept) if kept else (max(drawn)[1] if drawn else "")
    if op == "swap":
        order = sorted(range(n), key=lambda i: (h("swap", key, i), i))
        out = list(tokens)
        for a, b in zip(order[: 2 * k : 2], order[1 : 2 * k : 2]):
            out[a], out[b] = tokens[b], tokens[a]
        return " ".join(out)
    picks = sorted((h("synonym", key, i), i) for i, t in enumerate(tokens) if t in SYNONYMS)[:k]
    chosen = {}
    for _, i in picks:
        options = SYNONYMS[tokens[i]]
        chosen[i] = options[u32(h("pick", key, i)) * len(options) // 2**32]
    if op == "synonym":
        return " ".join(chosen.get(i, t) for i, t in enumerate(tokens))
    placed = [(u32(h("place", key, i)) * n // 2**32, rank, chosen[i]) for rank, (_, i) in enumerate(picks)]
    placed += [(i, n + 1, t) for i, t in enumerate(tokens)]
    return " ".join(t for *_, t in sorted(placed))


@pytest.fixture(scope="module")
def synonym_table(spark):
    rows = [(t, n, s) for t, ss in SYNONYMS.items() for n, s in enumerate(ss)]
    return spark.createDataFrame(rows, "token string, n int, synonym string")


@pytest.mark.parametrize("broadcast_bytes", [di.BROADCAST_BYTES, 0])
def test_eda_matches_brute_force(corpus, synonym_table, broadcast_bytes):
    lookup = SynonymLookup(synonym_table, broadcast_bytes=broadcast_bytes)
    rows = eda_augment(corpus(TEXTS), lookup).collect()
    assert len(rows) == 5 * len(TEXTS)
    assert len({r.row_key for r in rows}) == len(rows)
    for r in rows:
        text = TEXTS[int(r.ID[1:])]
        assert r.text == py_eda(r.aug_kind, r.ID, text), (r.aug_kind, text)
        assert r.row_key == f"{r.ID}#{r.aug_kind}"


def test_eda_notebook_operations(corpus, synonym_table):
    out = eda_augment(corpus(TEXTS), synonym_table, NOTEBOOK_OPS)
    assert {r[0] for r in out.select("aug_kind").distinct().collect()} == set(NOTEBOOK_OPS)


def test_swap_and_delete_need_no_shuffle(corpus, spark):
    df = spark.range(10).select(
        F.col("id").cast("string").alias("row_key"), F.lit("a b c").alias("text")
    )
    plan = eda_augment(df, None, ["original", "swap", "delete"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("broadcast_bytes", [di.BROADCAST_BYTES, 0])
def test_correct_tokens(spark, corpus, broadcast_bytes):
    table = spark.createDataFrame(
        [("teh", "the"), ("teh", "zzz"), ("b", "B")], "token string, correction string"
    )
    lookup = di.correction_lookup(table, broadcast_bytes=broadcast_bytes)
    texts = ["teh  cat\tteh\n", " b", "none here", "", "  ", None]
    rows = di.correct_tokens(corpus(texts), lookup).orderBy("ID").collect()
    assert [r.text for r in rows] == ["the  cat\tthe\n", " B", "none here", "", "  ", None]
    assert rows[0].row_key == "r0#corrected"


@pytest.mark.parametrize("broadcast_bytes", [di.BROADCAST_BYTES, 0])
def test_pivot_rewrite(spark, corpus, broadcast_bytes):
    forward = spark.createDataFrame(
        [("en", "a", "A"), ("en", "b", "B"), ("de", "a", "AA"), ("fr", "a", "FA")],
        "lang string, src string, dst string",
    )
    back = spark.createDataFrame(
        [("en", "A", "a1"), ("en", "B", "b1"), ("de", "AA", "a2"), ("fr", "FA", "a3")],
        "lang string, src string, dst string",
    )
    pivots = di.PivotLookup(forward, back, ["en", "de"], broadcast_bytes=broadcast_bytes)
    df = corpus(["a  b", "a", "a c", None])
    keep = di.pivot_rewrite(df, pivots)
    got = {(r.ID, r.aug_kind): r.text for r in keep.collect()}
    assert got == {
        ("r0", "pivot_en"): "a1 b1", ("r0", "pivot_de"): "a  b",
        ("r1", "pivot_en"): "a1", ("r1", "pivot_de"): "a2",
        ("r2", "pivot_en"): "a c", ("r2", "pivot_de"): "a c",
        ("r3", "pivot_en"): None, ("r3", "pivot_de"): None,
    }
    drop = di.pivot_rewrite(df, pivots, on_error="drop")
    assert {(r.ID, r.aug_kind) for r in drop.collect()} == {
        ("r0", "pivot_en"), ("r1", "pivot_en"), ("r1", "pivot_de"),
    }
    assert di.pivot_rewrite(df, pivots, ["en"]).count() == 4
    with pytest.raises(ValueError):
        di.pivot_rewrite(df, pivots, on_error="ignore")


def test_naive_augment_and_accumulation(corpus):
    df = corpus(["Ab, 가나!\tx", None])
    rows = {(r.ID, r.aug_kind): r.text for r in naive_augment(df, KOREAN).collect()}
    assert rows[("r0", "plain")] == "Ab 가나x"
    assert rows[("r0", "lower")] == "ab, 가나!\tx"
    assert rows[("r0", "spaced")] == "Ab,  가나!  x"
    assert rows[("r0", "original")] == "Ab, 가나!\tx"
    assert rows[("r1", "lower")] is None
    total = augment(df, [naive_augment, noise_filtering])
    assert total.count() == 5 * df.count()
    assert set(total.columns) == {"row_key", "ID", "text", "target", "aug_kind"}


def test_score_batches_bounds_batches_and_keeps_the_model(corpus):
    def factory():
        state = {"batches": 0}

        def model(texts):
            state["batches"] += 1
            sizes = texts.fillna("").str.len()
            assert len(texts) == 1 or sizes.sum() <= 40
            return texts.map(lambda t: f"{state['batches']}|{len(texts)}")

        return model

    texts = ["x" * 10] * 9 + ["y" * 500, None, "", "z" * 39]
    for _ in range(2):
        df = corpus(texts).coalesce(1)
        rows = score_batches(df, factory, "seen", max_bytes=40).collect()
        assert [r.text for r in rows] == texts
    numbers = [int(r.seen.split("|")[0]) for r in rows if r.seen]
    assert numbers == sorted(numbers) and len(set(numbers)) >= 4


def test_score_batches_loads_once_per_task(corpus):
    def factory():
        return lambda texts: texts.fillna("").str.upper()

    rows = score_batches(corpus(["ab", None]), factory).orderBy("ID").collect()
    assert [r.text for r in rows] == ["AB", ""]


def test_results_do_not_depend_on_partitioning(corpus, spark, synonym_table):
    results = []
    for partitions in (1, 7, 200):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        df = corpus(TEXTS).repartition(partitions)
        out = eda_augment(df, synonym_table, ALL_OPS)
        results.append(sorted((r.row_key, r.text) for r in out.collect() if r.text is not None))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_lookups_do_not_depend_on_the_broadcast_bound(spark, limit):
    """Repeated tokens and row keys, gaps and repeats in n: one result either way."""
    rows = [("k", "aa bb aa", 0), ("k", "bb cc", 1), ("m", "", 2)]
    df = spark.createDataFrame(rows, "row_key string, text string, target int")
    entries = spark.createDataFrame([("aa", "y"), ("aa", "x"), ("bb", "z")], "token string, correction string")
    lookup = di.correction_lookup(entries, broadcast_bytes=limit)
    fixed = di.correct_tokens(df, lookup).select("target", "text")
    assert sorted(map(tuple, fixed.collect())) == [(0, "x z x"), (1, "z cc"), (2, "")]
    pairs = [("aa", 3, "p"), ("aa", 9, "q"), ("aa", 9, "p"), ("bb", 5, "r")]
    synonyms = SynonymLookup(spark.createDataFrame(pairs, "token string, n int, synonym string"), limit)
    out = eda_augment(df, synonyms, ops=("synonym", "insert"))
    got = sorted(map(tuple, out.select("target", "aug_kind", "text").collect()))
    want = eda_augment(df, SynonymLookup(synonyms.synonyms, 1 << 20), ops=("synonym", "insert"))
    assert got == sorted(map(tuple, want.select("target", "aug_kind", "text").collect()))
    assert len(got) == 6


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("most_listed", [0, 16])
def test_large_dictionaries_are_shuffled_once_and_never_broadcast(spark, monkeypatch, most_listed):
    """Files of 64 KB are far below Spark's own limit, what they hold in copies is not."""
    monkeypatch.setattr("corpusmith.operators.eda.MOST_LISTED", most_listed)
    words = spark.range(3000).select(F.concat(F.lit("word"), "id").alias("token"))
    text = F.concat_ws(" ", F.lit("word7"), F.concat(F.lit("word"), "id"), F.lit("none"), F.lit("word7"))
    df = spark.range(300).select(F.col("id").cast("string").alias("row_key"), text.alias("text"))
    lookup = di.correction_lookup(words.select("token", F.upper("token").alias("correction")), broadcast_bytes=0)
    fixed = di.correct_tokens(df, lookup)
    assert sorted(r.text for r in fixed.collect()) == sorted(f"WORD7 WORD{i} none WORD7" for i in range(300))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(1))).alias("n")
    pairs = words.select("token", numbers).withColumn("synonym", F.concat("token", F.lit("-"), "n"))
    drawn = eda_augment(df, SynonymLookup(pairs, 0), ["synonym"])
    small = eda_augment(df, SynonymLookup(pairs), ["synonym"])
    assert sorted(drawn.collect()) == sorted(small.collect())
    for plan in (_plan(fixed), _plan(drawn)):
        assert "Broadcast" not in plan
        # no copies of the dictionary: all that is exploded are the keys of the texts
        assert plan.count("Generate explode") == 1


def test_score_batches_leaves_other_columns_alone(spark):
    """Whole numbers beside a null, once turned into floats with all of their batch."""
    rows = [("a", 2**53 + 1), ("b", None), (None, 7)]
    df = spark.createDataFrame(rows, "text string, n bigint").coalesce(1)
    out = score_batches(df, lambda: lambda texts: texts.fillna("").str.upper(), "seen")
    assert [tuple(r) for r in out.collect()] == [("a", 2**53 + 1, "A"), ("b", None, "B"), (None, 7, "")]
