"""Tokens of many texts at once, as numbers into the distinct ones.

Whitespace is found in the bytes of all texts together, and what is made of tokens is made
of their numbers, so that no token ever becomes an object of its own. The tokens are those
of ``text.tokens`` and the pieces between them those of ``text.token_pieces``.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusmith.profiles import WS

_SPACES = [chr(c).encode() for lo, hi in WS.ranges for c in range(lo, hi + 1)]
_ONE_BYTE = np.zeros(256, bool)
_ONE_BYTE[[s[0] for s in _SPACES if len(s) == 1]] = True
# of longer ones the first bytes, and all of them as a number by their length
_LEADS = np.zeros(256, bool)
_LEADS[[s[0] for s in _SPACES if len(s) > 1]] = True
_LONGER = {n: [int.from_bytes(s) for s in _SPACES if len(s) == n] for n in sorted({len(s) for s in _SPACES} - {1})}


def _blank(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to whitespace."""
    found = _ONE_BYTE[data]
    leads = np.flatnonzero(_LEADS[data])
    for n, numbers in _LONGER.items() if len(leads) else ():
        whole = leads[leads + n <= len(data)]
        value = np.zeros(len(whole), np.int64)
        for i in range(n):
            value = value << 8 | data[whole + i]
        for i in range(n):
            found[whole[np.isin(value, numbers)] + i] = True
    return found


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _strings(data: pa.Buffer, starts: np.ndarray) -> pa.Array:
    """The strings of ``data`` that begin at each of ``starts`` but the last."""
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), data)


def one_array(column: pa.Array | pa.ChunkedArray, kind: pa.DataType | None = None) -> pa.Array:
    column = column if kind is None else column.cast(kind)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Tokens:
    """Of some texts: ``words``, the distinct tokens; ``codes``, the number of each token's
    word, text after text; ``starts``, where the codes of each text begin."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        texts = one_array(texts, pa.string())
        self.valid = texts.is_valid()
        # a copy of a part of an array, so that its text begins at the first byte
        whole = pa.concat_arrays([texts.fill_null(""), pa.array([""], pa.string())])
        size, n = len(texts), len(texts) + 1
        begins = np.frombuffer(whole.buffers()[1], np.int32, n + 1)[:n]
        first, last = int(begins[0]), int(begins[-1])
        self.data = whole.buffers()[2].slice(first, last - first) if last > first else pa.py_buffer(b"")
        begins = (begins - first).astype(np.int64)
        data = np.frombuffer(self.data, np.uint8)
        blank = _blank(data)
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = blank[1:] != blank[:-1]
        edge[begins] = True
        edges = np.flatnonzero(edge)  # the last one is the end of all
        self.edges = edges
        self.is_token = ~blank[edges[:-1]]
        self.piece_starts = np.searchsorted(edges, begins)
        self.pieces = _strings(self.data, edges)
        self.token_places = np.flatnonzero(self.is_token)
        encoded = self.pieces.take(pa.array(self.token_places)).dictionary_encode()
        self.words, self.codes = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        self.starts = np.searchsorted(self.token_places, self.piece_starts)
        self.sizes = np.diff(self.starts)
        self.size = size

    @cached_property
    def rows(self) -> np.ndarray:
        """The text of each token."""
        return np.repeat(np.arange(self.size), self.sizes)

    @cached_property
    def places(self) -> np.ndarray:
        """The position of each token in its text."""
        return np.arange(len(self.codes)) - self.starts[self.rows]

    @cached_property
    def led_by_space(self) -> np.ndarray:
        """Which texts begin with whitespace or are empty."""
        filled = np.diff(self.piece_starts) > 0
        led = ~filled
        led[filled] = ~self.is_token[self.piece_starts[:-1][filled]]
        return led & self.valid.to_numpy(zero_copy_only=False)

    def of_size(self, n: int) -> tuple[np.ndarray, pa.Array]:
        """Where ``n`` tokens of one text follow each other, and these, joined by spaces."""
        at = np.flatnonzero(self.places + n <= self.sizes[self.rows])
        if n == 1:
            return at, self.words.take(pa.array(self.codes))
        parts = [self.words.take(pa.array(self.codes[at + k])) for k in range(n)]
        return at, pc.binary_join_element_wise(*parts, " ")

    def joined(self, words: pa.Array, codes: np.ndarray, starts: np.ndarray) -> pa.Array:
        """For each text its ``words`` with single spaces between them; null for null, and
        where one of them is null."""
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words.take(pa.array(codes)))
        return pc.if_else(self.valid, pc.binary_join(lists, " "), pa.scalar(None, pa.string()))

    def replaced(self, words: pa.Array, codes: np.ndarray) -> pa.Array:
        """The texts with ``words`` in place of their tokens, and the whitespace between
        them as it is."""
        spaces = self.pieces.take(pa.array(np.flatnonzero(~self.is_token))).dictionary_encode()
        every = np.empty(len(self.is_token), np.int64)
        every[self.is_token] = codes
        every[~self.is_token] = spaces.indices.to_numpy().astype(np.int64) + len(words)
        taken = pa.concat_arrays([words, spaces.dictionary]).take(pa.array(every))
        ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1) if len(taken) else np.zeros(1, np.int32)
        made = _strings(taken.buffers()[2] or pa.py_buffer(b""), ends[self.piece_starts])
        return pc.if_else(self.valid, made, pa.scalar(None, pa.string()))


def found_in(words: pa.Array, tokens: pa.Array) -> np.ndarray:
    """The place of each word in ``tokens``, -1 where it is missing."""
    return pc.fill_null(pc.index_in(words, value_set=tokens), -1).to_numpy().astype(np.int64)
