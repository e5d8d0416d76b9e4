"""Hashed n-grams against MLlib's tokenizer, n-grams and hashing, vector by vector."""

import random
import time

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer
from pyspark.sql import functions as F

from corpusmith.operators import models
from corpusmith.operators.grams import HashedGrams
from corpusmith.profiles import WS

ODD = ["", " ", "a", "\ta  B　c\n", "Straße İΣΑΣ", "𝄞x 𝄞", "é", "a\r\nb", "가나다 라", "x" * 70, "  a b  "]


def texts():
    chance = random.Random(5)
    made = ["".join(chance.choice("abcÄé \n 가𝄞.") for _ in range(chance.randint(0, 90))) for _ in range(300)]
    return [*ODD, *made, "word " * 3000, *ODD]


def plain(unit, n, size):
    pattern, gaps = (f"{WS.klass()}+", True) if unit == "word" else ("(?s).", False)
    stages = [RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=pattern, gaps=gaps)]
    stages.append(NGram(n=n, inputCol="_tokens", outputCol="_grams"))
    return Pipeline(stages=[*stages, HashingTF(inputCol="_grams", outputCol="_plain", numFeatures=size)])


@pytest.mark.parametrize("unit,n,size", [("word", 1, 4096), ("word", 2, 1000), ("char", 1, 64), ("char", 2, 1024), ("char", 3, 4096)])
def test_vectors_are_those_of_mllib(spark, unit, n, size):
    df = spark.createDataFrame([(t,) for t in texts()], "_text string").repartition(3)
    made = HashedGrams(inputCol="_text", outputCol="_tf", numFeatures=size, unit=unit, n=n).transform(df)
    rows = plain(unit, n, size).fit(df).transform(made).select("_text", "_tf", "_plain").collect()
    assert len(rows) == len(texts())
    for row in rows:
        assert row._tf == row._plain, row._text


def test_whitespace_is_that_of_the_profiles():
    ws = {chr(c) for lo, hi in WS.ranges for c in range(lo, hi + 1)}
    assert {chr(c) for c in range(0x110000) if chr(c).isspace()} == ws


def test_a_saved_model_is_the_same(spark, tmp_path):
    df = spark.createDataFrame([("a b a",)], "_text string")
    grams = HashedGrams(inputCol="_text", outputCol="_tf", numFeatures=32, unit="char", n=2)
    PipelineModel([grams]).write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert loaded.transform(df).head() == grams.transform(df).head()


def test_an_ensemble_reads_its_texts_once_for_training(spark):
    words = {0: "ball goal team", 1: "bank stock price", 2: "vote party law"}
    rows = [(f"k{i}", None if i == 7 else f"{words[i % 3]} filler{i % 11}", i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "row_key string, text string, target int")
    specs = [
        models.TextModelSpec("word", 1, num_features=256, max_iter=5, num_classes=4),
        models.TextModelSpec("char", 2, num_features=128, max_iter=5, num_classes=4, idf=True),
    ]
    alone = [models.train(df, spec) for spec in specs]
    reads = spark.sparkContext.accumulator(0)

    def seen(text):
        reads.add(1)
        return text

    counting = df.withColumn("text", F.udf(seen)("text"))
    together = models.train_ensemble(counting, specs)
    assert reads.value == 60
    for one, other in zip(alone, together):
        for a, b in zip(models.score(df, one).collect(), models.score(df, other).collect()):
            assert a.row_key == b.row_key and len(b.probs) == 4
            assert b.probs == pytest.approx(a.probs, abs=1e-6)


def test_a_text_takes_a_fraction_of_the_time_of_mllib(spark):
    chance = random.Random(7)
    words = ["".join(chance.choice("abcdefghij") for _ in range(chance.randint(2, 9))) for _ in range(3000)]
    rows = [(" ".join(chance.choices(words, k=1000)),) for _ in range(200)]
    df = spark.createDataFrame(rows, "_text string").repartition(1).cache()
    ours = HashedGrams(inputCol="_text", outputCol="_plain", numFeatures=4096, unit="char", n=3)
    took = {}
    for name, model in (("mllib", plain("char", 3, 4096).fit(df)), ("ours", ours)):
        for _ in range(2):  # the second time counts
            start = time.perf_counter()
            model.transform(df).agg(F.count_if(F.col("_plain").isNotNull())).head()
            model.transform(df).select("_plain").write.format("noop").mode("overwrite").save()
            took[name] = time.perf_counter() - start
    assert took["ours"] < took["mllib"]
