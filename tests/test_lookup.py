"""Look-ups by blocks of text: what is asked for, and how often the text travels."""

import pyarrow as pa
from pyspark.sql import functions as F

from corpusmith.operators.dictionary import _asked, look_up_in_blocks
from corpusmith.sources.staging import stage


def test_text_is_shuffled_once_and_keys_by_token_only(spark):
    rows = [(str(i), f"a b{i % 7} a c{i % 3}", i) for i in range(200)]
    rows += [("null", None, 1), ("empty", "", 2), ("7", "a b0 a c1", 7)]
    df = stage(spark.createDataFrame(rows, "row_key string, text string, target int"), "texts")
    values = [("a", "A"), ("b0", "B0"), ("c1", "C1"), ("unused", "U")]
    dictionary = stage(spark.createDataFrame(values, "token string, value string"), "values")
    keys = F.filter(F.split("text", " "), lambda t: t != "")
    found = look_up_in_blocks(df, keys, dictionary, "found")
    expected = sorted(
        (k, str(t), n, t if t is None else [dict(values).get(x) for x in t.split()]) for k, t, n in rows
    )
    got = found.collect()
    assert sorted((r.row_key, str(r.text), r.target, r.found) for r in got) == expected
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan
    # the keys go by token: no exchange deals pairs of block and token
    assert not any("hashpartitioning(_block" in x and "token" in x.split("hashpartitioning")[1] for x in plan.split("\n"))


def test_keys_of_a_batch_are_asked_once_per_block():
    keys = pa.array([["a", "b", "a"], None, [], ["b", None], ["a"]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 2, 1], pa.int32()), keys], ["_block", "_keys"])
    rows = [tuple(r.values()) for out in _asked(iter([batch])) for r in pa.Table.from_batches([out]).to_pylist()]
    assert sorted(rows, key=str) == [(1, "a"), (1, "b"), (2, "b"), (2, None)]
    # a part of a batch has the keys of its own rows only
    part = [r["token"] for out in _asked(iter([batch.slice(4)])) for r in out.to_pylist()]
    assert part == ["a"]
