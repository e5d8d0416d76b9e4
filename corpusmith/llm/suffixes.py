"""Suffix arrays of words, built with numpy inside a task.

Prefix doubling: suffixes in order of their first word are put in order of their
first 2, 4, 8, ... words, and each round touches only those that are still tied.
A rank is the place of the first suffix of its group, so a round leaves the ranks
of settled suffixes as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_slices(texts: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with at most ``max_bytes`` of text together, or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0)
    start = held = 0
    for i, size in enumerate(sizes.to_pylist()):
        if held and held + size > max_bytes:
            yield start, i
            start, held = i, 0
        held += size + 1
    if held:
        yield start, len(texts)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` for each start, ``size`` numbers each, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def sort_suffixes(
    keys: np.ndarray, positions: np.ndarray, ends: np.ndarray, depth: int, levels: list[np.ndarray] | None = None
) -> np.ndarray:
    """The suffixes at ``positions`` in order of their first ``depth`` words.

    ``keys`` orders the words; ``ends[i]`` is where the suffix at ``i`` ends, which
    sorts before any word. Suffixes that are equal up to their ends, or to
    ``depth``, stay in any order. ``levels`` receives, for 1, 2, 4, ... words, the
    ranks of all positions (0: none), followed by one 0.
    """
    first = keys[positions]
    order = np.argsort(first, kind="stable")
    sa, first = positions[order], first[order]
    heads = np.r_[True, first[1:] != first[:-1]] if len(sa) else np.zeros(0, bool)
    place = np.arange(len(sa))
    rank = np.zeros(len(keys) + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(heads, place, 0)) + 1
    tied = place[~(heads & np.r_[heads[1:], True])]
    span = len(sa) + 2
    width = 1
    while True:
        if levels is not None:
            levels.append(rank.astype(np.int32))
        # who has ended within these words equals its group for good
        tied = tied[ends[sa[tied]] - sa[tied] >= width]
        if not len(tied) or width >= depth:
            return sa
        at = sa[tied]
        behind = at + width
        key = rank[at] * span + np.where(behind < ends[at], rank[np.minimum(behind, len(keys))], 0)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[tied] = at
        heads = np.r_[True, key[1:] != key[:-1]]
        rank[at] = tied[np.maximum.accumulate(np.where(heads, np.arange(len(tied)), 0))] + 1
        tied = tied[~(heads & np.r_[heads[1:], True])]
        width *= 2
