"""Which looser spans stay beside base spans and each other."""

from corpusmith.llm import pii


def test_a_dropped_span_takes_no_place(spark):
    spans = [
        # base, a looser span over its end, and one that overlaps only the looser one
        (1, "email", 0, 10, True), (1, "phone", 8, 20, False), (1, "secret", 15, 30, False),
        # three looser ones in a chain: the second goes, the third stays
        (2, "email", 0, 10, False), (2, "phone", 8, 20, False), (2, "secret", 15, 30, False),
        # a base span behind drops the looser one before it
        (3, "email", 0, 10, False), (3, "phone", 8, 20, False), (3, "secret", 18, 30, True),
        # base spans always stay
        (4, "email", 0, 10, True), (4, "phone", 5, 12, True), (4, "secret", 12, 14, False),
    ]
    frame = spark.createDataFrame(spans, "row_no long, kind string, start int, stop int, strict boolean")
    got = sorted((r.row_no, r.kind, r.start, r.stop, r.strict) for r in pii.settle(frame).collect())
    assert got == [spans[i] for i in (0, 2, 3, 5, 6, 8, 9, 10, 11)]
