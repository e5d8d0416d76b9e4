"""What a task holds of the keys it asks for, and where phrases are put together."""

import pyarrow as pa
from pyspark.sql import functions as F

from corpusmith.operators import dictionary as di
from corpusmith.operators.eda import _runs


def test_keys_of_a_task_are_sent_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(di, "MOST_ASKED", 4)
    texts = [["a b", "a c", None, "d"], ["e f", "a", "", "g"]]
    blocks = [[7, 9, 7, 7], [9, 9, 7, 7]]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(t, pa.string())], ["_block", "text"])
        for b, t in zip(blocks, texts)
    ]
    parts = list(di._asked_by_task(iter(batches), di.token_keys))
    assert len(parts) > 1 and all(part.schema.names == ["token", "_blocks"] for part in parts)
    for part in parts:
        assert len(set(part.column("token").to_pylist())) == part.num_rows <= 6
    asked = {(t, b) for part in parts for t, bs in zip(*part.to_pydict().values()) for b in bs}
    assert asked == {(t, b) for ts, bs in zip(texts, blocks) for text, b in zip(ts, bs) for t in (text or "").split()}
    assert list(di._asked_by_task(iter([]), di.token_keys)) == []


def test_phrases_meet_their_texts_in_one_python_step(corpus):
    """Once all phrases of a text, three for each token, came back to Spark as lists of lists
    and went to a second Python worker."""
    ddl = "lang string, src string, dst string"
    forward = corpus([""]).sparkSession.createDataFrame([("x", "a b", "1"), ("x", "c", "2")], ddl)
    lookup = di.PhraseLookup(forward, forward.select("lang", F.col("dst").alias("src"), F.upper("src").alias("dst")), ("x",), broadcast_bytes=0)
    out = di.phrase_rewrite(corpus(["a b c", "c a", None]), lookup, on_error="drop")
    assert [r.text for r in out.collect()] == ["A B C"]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    # the one that asks for phrases
    assert plan.count("MapInArrow") == 1 and plan.count("FlatMapCoGroupsInArrow") == 1
    assert "array<array<string>>" not in plan


def test_runs_of_a_token_become_lists_across_batches():
    rows = [("a", "1"), ("a", None), ("a", "3"), ("b", "4"), ("c", "5"), ("c", "6")]
    for size in range(1, 7):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows[i : i + size])], ["token", "synonym"])
            for i in range(0, len(rows), size)
        ]
        got = [tuple(r.values()) for b in _runs(iter(batches)) for r in b.to_pylist()]
        assert got == [("a", ["1", None, "3"]), ("b", ["4"]), ("c", ["5", "6"])]
    assert list(_runs(iter([]))) == []
