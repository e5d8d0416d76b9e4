"""Distributed numbering against sorting in Python, on skewed input."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from corpusmith.functions.columns import hash_hex
from corpusmith.operators import sampling
from corpusmith.operators.ranking import kth_rows, number_rows, rank_rows


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    # a third of all rows share one value and one group
    data = [(f"k{i}", "hot" if i % 3 == 0 else f"g{i % 5}", 7 if i % 3 == 0 else i % 4)
            for i in range(3000)]
    return spark.createDataFrame(data, "row_key string, g string, v int").repartition(5), data


def test_number_rows(rows):
    df, data = rows
    got = {r.row_key: r.position for r in number_rows(df, hash_hex(1, F.col("row_key"))).collect()}
    order = sorted(data, key=lambda r: (md5(1, r[0]), r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}


def test_rank_rows(rows):
    df, data = rows
    ranked = rank_rows(df, "v", hash_hex(1, F.col("row_key")))
    order = sorted(data, key=lambda r: (r[2], md5(1, r[0]), r[0]))
    assert {r.row_key: r["rank"] for r in ranked.collect()} == {
        r[0]: i + 1 for i, r in enumerate(order)
    }


def test_kth_rows_per_group(rows):
    df, data = rows
    want = {"hot": 700, "g0": 1, "g1": 150, "g2": 10_000}
    k = F.create_map(*[F.lit(x) for pair in want.items() for x in pair])[F.col("g")]
    keyed = df.withColumn("h", hash_hex(1, F.col("row_key"))).withColumn("k", k)
    edges = kth_rows(keyed.where("k is not null"), ["g"], ["v"], "h", "row_key", "k")
    got = {r.g: r.row_key for r in edges.collect()}
    expected = {}
    for g, n in want.items():
        order = sorted((r[2], md5(1, r[0]), r[0]) for r in data if r[1] == g)
        expected[g] = order[min(n, len(order)) - 1][2]
    assert got == expected


@pytest.mark.parametrize("n", [0, 1, 10, 501])
def test_split_exact_sizes(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("row_key"))
    train, valid = sampling.split_exact(df)
    keys = sorted(r[0] for r in valid.collect())
    order = sorted(map(str, range(n)), key=lambda k: (md5(sampling.SPLIT_SEED, "split", k), k))
    assert keys == sorted(order[: math.ceil(n * 0.2)])
    assert train.count() == n - len(keys)


def test_split_by_source_keeps_variants_together(spark):
    df = spark.range(2000).select(
        F.col("id").cast("string").alias("row_key"),
        (F.col("id") % 300).cast("string").alias("ID"),
    )
    train, valid = sampling.split_group(df)
    assert train.join(valid, "ID").isEmpty()
    assert train.count() + valid.count() == 2000
    train, valid = sampling.split_hash(df)
    assert 300 < valid.count() < 500


def test_sample_per_class(spark):
    df = spark.range(5000).select(
        F.col("id").cast("string").alias("row_key"),
        F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") % 9).cast("int")).alias("target"),
    )
    sample = sampling.sample_per_class(df, 10, 7)
    counts = {r.target: r["count"] for r in sample.groupBy("target").count().collect()}
    # classes 7 and 8 are out of range, 3 and 6 do not occur
    assert counts == {0: 10, 1: 10, 2: 10, 4: 10, 5: 10}
    plan = sample._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_sequential_ids_are_dense(spark):
    df = spark.range(1200).select(F.col("id").cast("string").alias("row_key"))
    ids = sorted(r.ID for r in sampling.sequential_ids(df).collect())
    assert ids == [f"ynat-v1_train_{i:05d}" for i in range(1, 1201)]


def test_large_numbers_are_not_cut(spark):
    row = spark.range(1).select(F.format_string(sampling.ID_FORMAT, F.lit(1234567)))
    assert row.head()[0] == "ynat-v1_train_1234567"


def test_shuffle_is_stable(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("row_key"))
    first = [r[0] for r in sampling.shuffle_rows(df.repartition(3)).collect()]
    second = [r[0] for r in sampling.shuffle_rows(df.repartition(11)).collect()]
    assert first == second != sorted(first)
    positions = sampling.shuffle_positions(df).orderBy("position").collect()
    assert [r.row_key for r in positions] == first
