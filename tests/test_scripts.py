"""Stretches of Hangul are cut short before terms are looked for."""

import random
import re

from pyspark.sql import functions as F

from corpusmith.functions import text as tx
from corpusmith.functions.charset import CharSet
from corpusmith.profiles import KOREAN, LATIN, TextProfile


def test_ratio_between_stretches_is_that_of_the_definition(spark):
    draw = random.Random(7)
    parts = [*KOREAN.allowed_terms, "가나다라마바", "마버아파", "시리즈", "스마트", "中国語", "힣", "é!", "7%", "٣%", " ", "\n"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 25))) for _ in range(3000)] + ["", None, "가" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    ratios = tx.hard_noise_ratio(F.col("text"), KOREAN), tx.hard_noise_ratio_plain(F.col("text"), KOREAN)
    got = df.select("text", ratios[0].alias("fast"), ratios[1].alias("plain"))
    assert got.where(~F.col("fast").eqNullSafe(F.col("plain"))).collect() == []


def test_what_is_left_of_a_stretch(spark):
    pattern, mark = tx._inner_pattern(KOREAN)
    df = spark.createDataFrame([("A스마" + "가나다마라" * 1000 + "나트X", "A스마" + mark + "트X")], "text string, wanted string")
    assert df.where(F.regexp_replace("text", pattern, mark) == F.col("wanted")).count() == 1


def test_only_where_terms_need_another_script():
    assert tx._inner_pattern(LATIN) is None
    inside = TextProfile("x", KOREAN.signal, KOREAN.allowed, True, "x", KOREAN.plain, ("아이폰", "A8"))
    assert tx._inner_pattern(inside) is None


def test_class_of_many_ranges_has_the_same_characters():
    chars = CharSet.chars("aé" + "".join(chr(c) for c in range(0x100, 0x3000, 7)))
    klass = chars.klass()
    # halves are nested, so a miss is not compared with range after range
    assert klass.count("&&") > 100 and max(len(x) for x in re.findall(r"&&\[((?:\\x\{\w+\}-?)+)\]", klass)) < 60


def test_class_of_many_ranges_in_java(spark):
    chars = CharSet.chars("aé" + "".join(chr(c) for c in range(0x100, 0x3000, 7)) + "\U0001f600")
    points = [(c, chr(c)) for c in [*range(0x20, 0x3100), 0x1F5FF, 0x1F600, 0x1F601]]
    df = spark.createDataFrame(points, "n int, c string")
    found = {r.n for r in df.where(F.col("c").rlike(f"^{chars.klass()}$")).collect()}
    assert found == {n for n, c in points if c in chars}
