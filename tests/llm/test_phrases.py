"""Phrase mining against plain counting, with samples that miss phrases."""

import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest

from corpusmith.llm import phrases

SCHEMA = "doc_id long, text string, lang string, k int, phrase string, place long, n long, known boolean"


def windows(rows, max_words):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, max_words + 1):
                counts.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return counts, totals


def ranked(rows, max_words, min_count, top):
    counts, totals = windows(rows, max_words)
    often = {p: a for p, a in counts.items() if a >= min_count}
    best = {}
    for (lang, words), a in often.items():
        longer = [
            w for (o, w), b in often.items()
            if o == lang and b >= a and len(w) > len(words)
            and any(w[i : i + len(words)] == words for i in range(len(w)))
        ]
        if len(words) < 2 or longer:
            continue
        cuts = []
        for cut in range(1, len(words)):
            left, right = often[lang, words[:cut]], often[lang, words[cut:]]
            cuts.append((1000 * a * totals[lang] // (left * right), cut, left, right))
        score, _, left, right = min(cuts)
        best.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, rank, p.decode(), -a, left, right, totals[lang], -score)
        for lang, of in best.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(of)[:top], 1)
    }


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "p", 1, 1, True) for r in rows], SCHEMA)


TEXTS = [
    "The cat sat on the mat. the CAT sat on the mat, a dog ran; the cat sat",
    "a rose is a rose is a rose is a rose\nis a\x0brose\tis a rose",
    "x x x x x x x x x x x\x00y x\x00y x\x00y Émile\xa0Zola Émile\xa0Zola Émile\xa0Zola",
    "", None, " \t ", "...", "one", "one", "rare pair here! rare pair here! rare pair here? rare pair here",
]
ROWS = [(i, t, ["en", "fr", None][i % 3]) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "en"), (1, TEXTS[1], "fr")]


@pytest.mark.parametrize("sample", [1, 4, 1000])
def test_ranks_are_exact_whatever_the_sample(spark, sample):
    got = phrases.collocations(frame(spark, ROWS), min_count=3, top=None, sample=sample).collect()
    assert {tuple(r) for r in got} == ranked(ROWS, 5, 3, None) and len(got) > 10


def test_border_failures_are_expanded(spark):
    """Every frequent phrase is missed by the sample but for single words."""
    rows = [(i, "p q r s t u v w. p q r s t u v w", "en") for i in range(3)]
    counts, _ = windows(rows, 5)
    for sample in (1, 1000):
        got, totals = phrases.frequent_phrases(frame(spark, rows), min_count=5, sample=sample)
        assert {(r.lang, tuple(r.phrase.split())): r.n for r in got.collect()} == counts
        assert [tuple(r) for r in totals.collect()] == [("en", 48)]


def test_products_beyond_64_bits_and_top(spark):
    got = phrases.collocations(frame(spark, ROWS), min_count=3, top=2, sample=4).collect()
    assert {tuple(r) for r in got} == ranked(ROWS, 5, 3, 2)
    assert all(isinstance(r.score, int) for r in got)


def test_no_rows(spark):
    docs = frame(spark, ROWS).where("false")
    assert phrases.collocations(docs, min_count=3).collect() == []
    assert phrases.collocations(frame(spark, [(1, None, None)]), min_count=1).collect() == []


def test_memory_is_that_of_a_slice_not_of_a_batch():
    """A task holds the arrays of some text of its batch, in the counts and in the expansion."""
    words = np.random.default_rng(1).integers(0, 5000, (1000, 700))
    texts = [" ".join(f"w{w}" for w in row) for row in words]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts})
    assert batch.nbytes > 3 << 20
    known = np.zeros((1 << phrases.BITS) // 8, np.uint8)
    for pieces in phrases._pieces_of(batch):
        hashes = pieces.words().hash
        place = (hashes >> np.uint64(64 - phrases.BITS)).astype(np.int64)
        np.bitwise_or.at(known, place >> 3, (1 << (place & 7)).astype(np.uint8))
    sent = SimpleNamespace(value=known)
    with mock.patch.object(phrases, "_summed", lambda texts, run: run):
        runs = phrases._count(None, sent, 5), phrases._expand(None, sent, sent, 5)
    for run in runs:
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6
