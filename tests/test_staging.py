"""What staging leaves on disk."""

import os

from pyspark.sql import functions as F

from corpusmith.plans import flows
from corpusmith.profiles import LATIN
from corpusmith.sources import staging
from corpusmith.sources.staging import stage


def shuffle_files(spark) -> set[str]:
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    folders = env.blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def test_shuffles_of_a_staged_table_go_with_its_query(spark):
    before = shuffle_files(spark)
    rows = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    staged = stage(rows, "sums")
    assert shuffle_files(spark) <= before
    # the frame can be computed again, and other queries keep their shuffles as before
    assert sorted(rows.collect()) == sorted(staged.collect())
    assert spark.conf.get(staging._REMOVE_SHUFFLES) == "false"


def test_only_the_noisy_side_is_staged(corpus, monkeypatch):
    staged = []
    monkeypatch.setattr(flows, "stage", lambda df, label: staged.append(stage(df, label)) or staged[-1])
    texts = ["clean words", "noisy!! ### text", "more clean words", None, "§§§"]
    noisy, clean = flows._sides(corpus(texts), "hard", LATIN)
    assert sorted(r.text for df in staged for r in df.collect()) == ["noisy!! ### text", "§§§"]
    assert sorted(r.row_key for r in noisy.collect()) == ["r1#noisy", "r4#noisy"]
    assert sorted(r.row_key for r in clean.collect()) == ["r0#clean", "r2#clean"]
