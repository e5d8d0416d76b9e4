"""End-to-end flows on a small corpus."""

import pytest
from pyspark.sql import functions as F

from corpusmith.operators.bayes import BayesSpec
from corpusmith.operators.dictionary import PivotLookup, correction_lookup
from corpusmith.operators.eda import SynonymLookup
from corpusmith.operators.models import TextModelSpec
from corpusmith.operators.synth import LIST_MARKER
from corpusmith.plans import flows
from corpusmith.profiles import KOREAN
from corpusmith.sources.readers import read_corpus
from corpusmith.sources.sinks import write_corpus

SPEC = TextModelSpec(num_features=256, max_iter=3, num_classes=3)


@pytest.fixture(scope="module")
def small(spark):
    words = ["경제 주가 상승", "축구 경기 승리", "정부 정책 발표"]
    noise = ["", " # $", " k팝 !!"]
    rows = [
        (f"r{i}", f"r{i}", f"{words[i % 3]}{noise[i % 4 % 3]} {i}", i % 3) for i in range(60)
    ]
    return spark.createDataFrame(rows, "row_key string, ID string, text string, target int")


@pytest.fixture(scope="module")
def resources(spark):
    pairs = spark.createDataFrame([("en", "경제", "x")], "lang string, src string, dst string")
    back = spark.createDataFrame([("en", "x", "경기")], "lang string, src string, dst string")
    return flows.Resources(
        synonyms=SynonymLookup(
            spark.createDataFrame([("주가", 0, "증시")], "token string, n int, synonym string")
        ),
        pivots=PivotLookup(pairs, back),
        corrections=correction_lookup(
            spark.createDataFrame([("팝", "가요")], "token string, correction string")
        ),
        recover=lambda prompts: prompts.select(
            "row_key", F.lit('{"corrected_text": "복구"}').alias("output")
        ),
    )


def sizes(df):
    noisy = F.count_if(F.split("row_key", "#")[1] == "noisy")
    row = df.agg(noisy.alias("n"), F.count(F.lit(1)).alias("all"),
                 F.count_distinct("row_key").alias("keys")).head()
    assert row["keys"] == row["all"]
    return row["n"], row["all"] - row["n"]


def test_hard_flow_and_sinks(spark, small, resources, tmp_path):
    out = flows.hard_flow(small, resources, [SPEC], KOREAN)
    assert sizes(out) == (4 * 30, 8 * 30)
    path = str(tmp_path / "last")
    flows.finish(out, path, "csv")
    back = read_corpus(spark, path)
    assert back.columns == ["ID", "text", "target"] and back.count() == 360
    model, f1 = flows.train_and_evaluate(out, SPEC)
    assert 0 <= f1.head()[0] <= 1
    flows.predict_table(small.select("ID", "text"), model, spark, str(tmp_path / "out"))
    predicted = read_corpus(spark, str(tmp_path / "out"))
    assert predicted.count() == 60
    assert predicted.where(~F.col("target").between(0, 2)).isEmpty()


def test_soft_flow(small, resources):
    out = flows.soft_flow(small, resources, SPEC, KOREAN)
    noisy, clean = sizes(out)
    assert noisy % 8 == 0 and clean % 9 == 0 and noisy > 0 and clean > 0
    assert out.where("aug_kind = 'recovered' and text <> '복구'").isEmpty()


def test_relabel_run_takes_paths_and_frames(spark, small, tmp_path):
    spec = BayesSpec(num_features=256, num_classes=3)
    swapped = small.withColumn("target", F.when(F.col("ID") == "r3", 1).when(F.col("ID") == "r4", None).otherwise(F.col("target")))
    out = flows.relabel_run(small, swapped, spec)
    assert out.columns == swapped.columns and out.count() == 60
    paths = [str(tmp_path / "train.csv"), str(tmp_path / "relabel.parquet")]
    write_corpus(small, paths[0], fmt="csv")
    write_corpus(swapped, paths[1])
    read = flows.relabel_run(*paths, spec, spark)
    assert read.columns == ["ID", "text", "target"]
    told = {r.ID: r.target for r in out.collect()}
    assert told == {r.ID: r.target for r in read.collect()}
    # the label that was wrong and the one that was missing
    truth = {r.ID: r.target for r in small.collect()}
    assert told["r4"] == truth["r4"] and told["r3"] == truth["r3"]
    with pytest.raises(ValueError):
        flows.relabel_run(small, 5, spec)
    with pytest.raises(ValueError):
        flows.relabel_run(None, small, spec)


def test_notebook_flow(small, resources):
    out = flows.notebook_flow(small, resources, [SPEC], KOREAN)
    # every text has a token without a round trip
    assert sizes(out) == (4 * 30, 4 * 30)


def test_synthesis(spark, small, tmp_path):
    def generate(prompts):
        return prompts.select(
            F.concat(F.lit("p"), "target").alias("row_key"),
            "target",
            F.concat("prompt", F.lit('1. "새 제목"\n2. IT 기업들 성장\n')).alias("output"),
        )

    titles = flows.synthesize(small, generate)
    assert titles.count() == 6
    path = tmp_path / "synthetic"
    flows.finish_synthetic(titles, str(path))
    lines = sorted("".join(p.read_text() for p in path.glob("part-*")).splitlines())
    # every part file with rows starts with the header
    lines = [line for line in lines if line != "ID,text,target"]
    assert [line.split(",")[:2] for line in lines] == [
        [f"ynat-v1_train_0000{i}", "새 제목"] for i in (1, 2, 3)
    ]
    assert LIST_MARKER  # the prompt ends with it, so only the answer is parsed
