"""Tokens of many texts, against Python's."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusmith.functions.tokens import Tokens, found_in

PIECES = ["a", "bb", "가나", "é", "😀", "‧", "、", " ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", " ", "᠎", "﻿"]


def texts_of(seed, n=400):
    rng = random.Random(seed)
    made = ["".join(rng.choices(PIECES, k=rng.randrange(12))) for _ in range(n)]
    return [None if rng.random() < 0.05 else t for t in made]


@pytest.mark.parametrize("texts", [texts_of(1), [], [None], [""], ["", None, ""], [" "], ["x"], ["x "], [" x", "y"]])
def test_tokens_are_those_of_split(texts):
    got = Tokens(pa.chunked_array([pa.array([*texts, "z", " q "], pa.string()).slice(0, len(texts))]))
    words = got.words.to_pylist()
    assert len(set(words)) == len(words)
    lists = [[words[c] for c in got.codes[a:b]] for a, b in zip(got.starts[:-1], got.starts[1:])]
    assert lists == [(t or "").split() for t in texts]
    assert got.rows.tolist() == [i for i, x in enumerate(lists) for _ in x]
    assert got.places.tolist() == [k for x in lists for k in range(len(x))]
    assert got.led_by_space.tolist() == [t is not None and (not t or t[0].isspace()) for t in texts]
    joined = got.joined(got.words, got.codes, got.starts).to_pylist()
    assert joined == [t if t is None else " ".join(t.split()) for t in texts]
    upper = pa.array([w.upper() + "!" for w in words], pa.string())
    assert got.replaced(upper, got.codes).to_pylist() == [
        t if t is None else re.sub(r"\S+", lambda m: m[0].upper() + "!", t) for t in texts
    ]


def test_part_of_an_array_and_runs_of_tokens():
    whole = pa.array(["no", "a b a c", None, "x", " p  q r"])
    got = Tokens(whole.slice(1))
    at, pairs = got.of_size(2)
    assert pairs.to_pylist() == ["a b", "b a", "a c", "p q", "q r"] and at.tolist() == [0, 1, 2, 5, 6]
    at, longer = got.of_size(3)
    assert longer.to_pylist() == ["a b a", "b a c", "p q r"]
    assert found_in(pa.array(["q", "zz", "a"]), pa.array(["a", "q"])).tolist() == [1, -1, 0]
    missing = pa.array([None if w == "c" else w for w in got.words.to_pylist()])
    assert got.joined(missing, got.codes, got.starts).to_pylist() == [None, None, "x", "p q r"]
    assert np.array_equal(got.sizes, [4, 0, 1, 3])
