"""Benchmark passages against a comparison of all windows."""

import hashlib
import re

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmith.llm import decontaminate
from corpusmith.llm.queries import op13_decontaminate
from tests.llm.test_contracts import FOLDER, docs  # noqa: F401


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def hits(text, items, window, with_longest=True):
    words, hit, names, longest = words_of(text), set(), set(), 0
    for name, item in items:
        own = words_of(item)
        size = min(window, len(own))
        wanted = {}
        for j in range(len(own) - size + 1 if size else 0):
            wanted.setdefault(tuple(own[j : j + size]), []).append(j)
        for i in range(len(words) - size + 1 if size else 0):
            for j in wanted.get(tuple(words[i : i + size]), []):
                names.add(str(name) if name is not None else "")
                hit.update(range(i, i + size))
                k = size
                while with_longest and i + k < len(words) and j + k < len(own) and words[i + k] == own[j + k]:
                    k += 1
                longest = max(longest, k)
    return len(words), len(hit), sorted(names), longest


def found(rows):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.longest) for r in rows)


word = st.sampled_from(["a", "B", "b", "7", "é", "zz"])
texts = st.lists(st.one_of(word, st.sampled_from([".", "'", "\n"])), max_size=25).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4), st.lists(texts, min_size=1, max_size=4), st.integers(1, 4))
def test_matches_of_a_shard(items, docs_, window):
    named = list(enumerate(items))
    pieces = [p for n, t in named for p in decontaminate._pieces(str(n), t.encode(), window)]
    if not pieces:
        return
    block = decontaminate.Block.of(pieces, window)
    joined = [f"{d} {items[0]} {d}" for d in docs_] + [None, ""]
    got = decontaminate._matches([t.encode() if t is not None else None for t in joined], block)
    for text, n, spans, names, longest in zip(joined, *got):
        assert hits(text, named, window) == (n, sum(b - a for a, b in spans), sorted(names), longest)


@pytest.fixture(scope="module")
def odd(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage), (1, passage), (2, None), (None, f"ab {passage[:50]} x"), (3, ""), (4, "..."), (5, "Short ITEM")]
    rows += [(6, "long text " * 30_000 + passage), (7, "w3-w4 w5"), (8, "short. item"), (9, "a " * 40)]
    schema = "doc_id long, text string, row string, found int, items string, spans string"
    docs_ = spark.createDataFrame([(*r, "r", 1, "i", "s") for r in rows], schema)
    items = [(10, passage), (10, "short item"), (9, None), (8, ""), (None, "long text"), (7, "a " * 15), (6, "!!")]
    return docs_, rows, spark.createDataFrame(items, "item_id long, text string"), items


def test_odd_rows(spark, odd):
    docs_, rows, benchmark, items = odd
    got = decontaminate.report(docs_, benchmark).collect()
    assert found(got) == sorted((str(d), *hits(t, items, 10)) for d, t in rows)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)


def test_clean_rows_stay_whole(spark, odd):
    docs_, rows, benchmark, items = odd
    kept = decontaminate.remove_contaminated(docs_, benchmark)
    assert kept.columns == docs_.columns
    want = [d for d, t in rows if not hits(t, items, 10)[1]]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, want))


def test_blocks_and_pieces_change_nothing(spark, odd, monkeypatch):
    docs_, rows, benchmark, items = odd
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 25)
    got = decontaminate.report(docs_, benchmark).drop("longest").collect()
    want = sorted((str(d), *hits(t, items, 10, False)[:3]) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == want


def test_empty_tables(spark, odd):
    docs_, rows, benchmark, _ = odd
    assert decontaminate.report(docs_.where("false"), benchmark).collect() == []
    got = decontaminate.report(docs_, benchmark.where("false")).collect()
    assert found(got) == sorted((str(d), len(words_of(t)), 0, [], 0) for d, t in rows)
    assert decontaminate.remove_contaminated(docs_, benchmark.where("false")).count() == len(rows)


def test_op13(spark, docs):  # noqa: F811
    items = pq.read_table(f"{FOLDER}/benchmark.parquet").to_pydict()
    items = list(zip(items["item_id"], items["text"]))
    rows = op13_decontaminate(spark, FOLDER).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows:
        n, n_hit, names, longest = hits(docs[r.doc_id], items, 10)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated, r.longest) == (n, n_hit, len(names), n_hit > 0, longest)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
