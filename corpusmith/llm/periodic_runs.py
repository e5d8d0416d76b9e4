"""Periodic runs of words, found with enhanced suffix arrays.

A run is a stretch of consecutive words with smallest period q and at least
``max(min_length, 2 * q)`` words that no neighbouring word extends keeping the
period. The last square of a run (its last 2q words) can't be moved to the
right, so the suffixes at its start and q words on share exactly q words: they
part at the node of depth q of the suffix tree. Each text's suffixes are sorted,
and for each interval of equal prefixes (depth d, from the LCP array, no tree
nodes) the suffixes ``i`` of the smaller child are tested: does suffix ``i + d`` or
``i - d`` stand in the other child, by the inverse array? Each such square is
rotated to the left as far as it stays a square, which spans the run; runs with
equal bounds are one, with the smallest period.

Suffixes of many texts are sorted together, the text being the first key, so no
prefix is shared between texts and numpy works on long arrays. Memory is bounded
by slices of ``SLICE_BYTES`` of text, or one text. Rows stay where they are: there is
no shuffle.

Words are what lies between ASCII white space. A null or blank text has no words,
no runs and an empty ``collapsed``. Ids may repeat or be null: each row is looked at
for itself and gives one row. Only ``doc_id`` and ``text`` are read, so other columns
can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.llm.common import Batches
from corpusmith.llm.suffixes import sort_suffixes, spread, text_slices

MIN_LENGTH = 12
SLICE_BYTES = 2 << 20
# suffixes tested at a time
_CHUNK = 1 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """``lcp[k]``: words that suffixes ``k - 1`` and ``k`` of ``sa`` share; -1 at both ends."""
    lcp = np.full(len(sa) + 1, -1, np.int64)
    alike = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    lcp[1:-1] = 0
    shared = _shared(sa[alike], sa[alike + 1], levels)
    lcp[alike + 1] = shared
    return lcp


def _shared(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    a, b = a.copy(), b.copy()
    start = a.copy()
    for k in range(len(levels) - 1, -1, -1):
        step = np.where(levels[k][a] == levels[k][b], 1 << k, 0)
        a += step
        b += step
    return a - start


def _shared_before(a: np.ndarray, b: np.ndarray, first: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that agree before ``a`` and before ``b``, not before ``first``."""
    a, gap = a.copy(), b - a
    start = a.copy()
    for k in range(len(levels) - 1, -1, -1):
        x = a - (1 << k)
        inside = np.maximum(x, 0)
        same = (x >= first) & (levels[k][inside] == levels[k][inside + gap])
        a = np.where(same, x, a)
    return start - a


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(left, k, right)`` of each boundary ``k`` with a common prefix: suffixes
    ``left..k-1`` and ``k..right-1`` are two children that part there. Of more
    children each is parted from those on its right, so no pair is met twice."""
    at = np.flatnonzero(lcp > 0)
    left, right = [0] * len(at), [0] * len(at)
    last = -2
    stack: list[tuple[int, int, int]] = []  # boundary, depth, number
    for n, (k, depth) in enumerate(zip(at.tolist(), lcp[at].tolist())):
        if k != last + 1:
            for _, _, m in stack[1:]:
                right[m] = last + 1
            stack = [(k - 1, 0, -1)]
        while stack[-1][1] > depth:
            right[stack.pop()[2]] = k
        left[n] = stack[-1][0]
        stack.append((k, depth, n))
        last = k
    for _, _, m in stack[1:]:
        right[m] = last + 1
    return np.array(left, np.int64), at, np.array(right, np.int64)


def squares(sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(i, d)``: the ``d`` words at ``i`` and those at ``i + d`` are equal, and the
    words that follow both differ."""
    left, at, right = intervals(lcp)
    place = np.full(len(sa) + 1, -1, np.int64)  # the inverse array
    place[sa] = np.arange(len(sa))
    low = at - left <= right - at
    start, size = np.where(low, left, at), np.where(low, at - left, right - at)
    other, other_end = np.where(low, at, left), np.where(low, right, at)
    found_i, found_d = [], []
    # nodes in chunks of so many suffixes, but one node at least
    chunk = (np.cumsum(size) - size) // _CHUNK
    bounds = np.r_[0, np.flatnonzero(np.diff(chunk)) + 1, len(chunk)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        i = sa[spread(start[a:b], size[a:b])]
        node = np.repeat(np.arange(a, b), size[a:b])
        d = lcp[at[node]]
        for shift in (d, -d):
            j = i + shift
            there = place[np.where((j >= 0) & (j < len(sa)), j, len(sa))]
            hit = (there >= other[node]) & (there < other_end[node])
            found_i.append(np.minimum(i, j)[hit])
            found_d.append(d[hit])
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_d)


def runs_of(words: np.ndarray, lengths: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows ``(text, start, length, period)`` in this order, of texts that stand one
    after another in ``words`` (numbers), ``lengths`` words each."""
    if not len(words):
        return np.zeros((0, 4), np.int64)
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    keys = text * (int(words.max()) + 1) + words
    levels: list[np.ndarray] = []
    sa = sort_suffixes(keys, np.arange(len(words)), ends[text], len(words), levels)
    i, period = squares(sa, common_prefixes(sa, levels))
    first = (ends - lengths)[text[i]]
    start = i - _shared_before(i, i + period, first, levels)
    length = i + 2 * period - start
    long = length >= min_length
    rows = np.stack([text[i], start - first, length, period], axis=1)[long]
    rows = rows[np.lexsort(rows.T[[3, 2, 1, 0]])]
    # of equal bounds the smallest period, then by start and period
    new = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)] if len(rows) else []
    rows = rows[new] if len(rows) else rows
    return rows[np.lexsort(rows.T[[3, 1, 0]])]


Arrange = Callable[[int, int], np.ndarray | None]


def _result(texts: list[bytes | None], marks: list, arrange: Arrange | None, min_length: int):
    words = [(text or b"").split() for text in texts]
    if arrange is not None:
        for n, (own, mark) in enumerate(zip(words, marks)):
            order = arrange(mark, len(own)) if own and mark is not None else None
            if order is not None:
                words[n] = [own[k] for k in order.tolist()]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
    numbers.default_factory = None  # a cycle, which would keep the words in memory
    rows = runs_of(ids, lengths, min_length)
    # words of a run after its first period are dropped
    change = np.zeros(len(ids) + 1, np.int64)
    begin = (np.cumsum(lengths) - lengths)[rows[:, 0]] + rows[:, 1]
    np.add.at(change, begin + rows[:, 3], 1)
    np.add.at(change, begin + rows[:, 2], -1)
    kept = np.cumsum(change[:-1]) == 0
    collapsed, at = [], 0
    has_runs = np.zeros(len(words), bool)
    has_runs[rows[:, 0]] = True
    for own, run in zip(words, has_runs.tolist()):
        some = compress(own, kept[at : at + len(own)].tolist()) if run else own
        collapsed.append(b" ".join(some))
        at += len(own)
    counts = np.bincount(rows[:, 0], minlength=len(words))
    offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
    values = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in (1, 2, 3)], fields=list(_RUN))
    return pa.ListArray.from_arrays(offsets, values), pa.array(collapsed, pa.binary()).cast(pa.string())


def find_runs(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    arrange: Arrange | None = None,
    mark: Column | None = None,
) -> DataFrame:
    """``(doc_id, runs, collapsed)``: one row per row of ``docs``.

    ``runs`` are ``(start, length, period)`` by start, then period, in words numbered
    from 0. ``collapsed`` is the text without the words that repeat the first period
    of a run, joined by single spaces. ``arrange`` may first put a text's words in
    another order: it gets the row's ``mark`` (an integer, not called on null) and
    the number of words and returns the old numbers in their new order, or None.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    mark = F.lit(None) if mark is None else mark

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a, b in text_slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(a, b - a)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                columns = _result(texts, part.column("mark").to_pylist(), arrange, min_length)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *columns], ["doc_id", "runs", "collapsed"]
                )

    wanted = docs.select("doc_id", "text", mark.cast("long").alias("mark"))
    return wanted.mapInArrow(run, f"doc_id {id_type}, runs {RUNS}, collapsed string")
