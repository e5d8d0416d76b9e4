"""A labelled id that many rows share is learned from once."""

import numpy as np

from corpusmith.llm import quality_model


def test_one_row_per_labelled_id(spark):
    rows = [(i, f"good words number {i}" if i % 2 else f"bad junk {i} {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    schema = "doc_id long, text string"
    once = quality_model.train(spark.createDataFrame(rows, schema), labels)
    often = quality_model.train(spark.createDataFrame(rows + [rows[3]] * 200, schema), labels)
    assert once.any() and np.array_equal(once, often)
