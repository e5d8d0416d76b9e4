"""Periodic runs against a comparison of all words with those q places on."""

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmith.llm import periodic_runs
from corpusmith.llm.queries import op12_periodic_runs, periodic_tail
from tests.llm.test_contracts import FOLDER, docs  # noqa: F401


def runs(words, min_length=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        k = 0
        while k < n - q:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k < n - q and words[k] == words[k + q]:
                k += 1
            if k - start + q >= max(min_length, 2 * q):
                found.setdefault((start, k - start + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


periodic = st.builds(
    lambda head, body, n, tail: head + (body * n)[: max(0, len(body) * n - 1)] + tail,
    st.lists(st.integers(0, 2), max_size=10),
    st.lists(st.integers(0, 3), min_size=1, max_size=6),
    st.integers(0, 9),
    st.lists(st.integers(0, 2), max_size=10),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(periodic, min_size=1, max_size=6), st.sampled_from([2, 4, 12]))
def test_runs_of_many_texts(texts, min_length):
    lengths = np.array([len(t) for t in texts], np.int64)
    words = np.array([w for t in texts for w in t], np.int64)
    want = [[k, *r] for k, t in enumerate(texts) for r in runs(t, min_length)]
    assert periodic_runs.runs_of(words, lengths, min_length).tolist() == want


def test_long_runs_and_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 800:
        a, b = b, b + a
    for words in (b, [7] * 3000, ([1] * 50 + [2]) * 9 + [1] * 50):
        got = periodic_runs.runs_of(np.array(words), np.array([len(words)])).tolist()
        assert [tuple(r[1:]) for r in got] == runs(words)


def test_odd_rows(spark):
    texts = [None, "", " \n", "a b " * 6, "a\tb\x0b" * 7 + "a\xa0b", "x " * 20_000, "one two " * 2 + "x " * 20_000]
    rows = [(None if i == 3 else i // 2, t, "r", 1) for i, t in enumerate(texts)] * 2
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, runs string, mark int")
    got = periodic_runs.find_runs(docs_).collect()
    want = []
    for d, t, *_ in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        found = [(0, 20_000, 1)] if t and t.startswith("x") else [(4, 20_000, 1)] if t and t.startswith("one") else runs(words)
        want.append((d, found, collapsed(words, found)))
    key = lambda r: (str(r[0]), r[2], len(r[1]))
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)
    assert periodic_runs.find_runs(docs_.where("false")).collect() == []


def test_op12(spark, docs):  # noqa: F811
    rows = op12_periodic_runs(spark, FOLDER).collect()
    assert len(rows) == len(docs) and any(r.n_runs for r in rows)
    for r in rows:
        words = [w.decode() for w in (docs[r.doc_id] or "").encode().split()]
        order = periodic_tail(zlib.crc32(str(r.doc_id).encode()), len(words)) if words else None
        words = words if order is None else [words[i] for i in order]
        found = runs(words) if len(words) < 3000 else [
            tuple(x[1:]) for x in periodic_runs.runs_of(
                np.unique(words, return_inverse=True)[1], np.array([len(words)])
            ).tolist()
        ]
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
