"""Benchmark passages in training texts, found with suffix arrays of the texts.

Each task sorts the suffixes of its texts, shard by shard (``SHARD_BYTES`` of text, or
one text), and binary-searches every suffix of every benchmark item in them, word
by word: the interval of training suffixes that agree narrows until it is empty.
That gives, for each test suffix, all places where its first ``window`` words stand
in training text (the whole item where it has fewer words), and how far each
match goes on. Texts are not shuffled and nothing is collected from them.

Only words that the benchmark has can be part of a match, so shards are sorted in
its vocabulary: any other word ends a suffix, as the end of the text does, and
suffixes need to be in order only as far as the longest item goes.

The benchmark is sent to the tasks in blocks of at most ``BLOCK_BYTES`` of text; pieces of
``PIECE_WORDS`` words that overlap by a window stand for longer items. Each block is
one pass over the texts, and what earlier passes found travels with the rows, so
any size of benchmark can be searched. A longest match is known up to a piece.

Words are what ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` matches after A to Z are lower-cased.
Null texts have no words: such a document is clean, such an item never occurs.
Ids may repeat or be null: each row of ``docs`` is judged for itself, rows of the
benchmark with one id are one item, and a null item id counts as an empty string. An
empty table gives an empty result; an empty benchmark finds nothing. Only ``text`` is
read from ``docs``, so other columns can't clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.llm.suffixes import sort_suffixes, spread, text_slices
from corpusmith.sources.staging import stage

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
PIECE_WORDS = 4096
# places listed at a time
_CHUNK = 1 << 20

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))
# no word has this byte
_END = b"\x00"

MATCHES = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>,longest:bigint>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_MATCHES = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(_SPAN)),
        ("items", pa.list_(pa.string())),
        ("longest", pa.int64()),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


class Block(NamedTuple):
    """Pieces of items as numbers of words from 1, one after another."""

    numbers: dict[bytes, int]
    words: np.ndarray
    left: np.ndarray  # words from each suffix to the end of its piece
    need: np.ndarray  # how many words of each suffix a match needs; 0: it is no window
    item: np.ndarray
    names: np.ndarray

    @classmethod
    def of(cls, pieces: list[tuple[str, list[bytes]]], window: int) -> Block:
        numbers: dict[bytes, int] = {}
        ids = [[numbers.setdefault(w, len(numbers) + 1) for w in words] for _, words in pieces]
        sizes = np.array([len(x) for x in ids], np.int64)
        names, item = np.unique(np.array([name for name, _ in pieces], object), return_inverse=True)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(int(sizes.sum()))
        need = np.repeat(np.minimum(sizes, window), sizes)
        need[left < need] = 0
        flat = np.fromiter((x for own in ids for x in own), np.int64, len(left))
        return cls(numbers, flat, left, need, np.repeat(item, sizes), names)


_held: dict[str, Block] = {}


def _loaded(name: str, pieces: Broadcast, window: int) -> Block:
    """One per Python worker, made for its first batch."""
    if name not in _held:
        _held.clear()
        _held[name] = Block.of(pieces.value, window)
    return _held[name]


def _pieces(name: str | None, text: bytes | None, window: int) -> Iterator[tuple[str, list[bytes]]]:
    words, step = words_of(text), PIECE_WORDS - window + 1
    for start in range(0, max(1, len(words) - window + 1), step):
        if words:
            yield name or "", words[start : start + PIECE_WORDS]


def _blocks(benchmark: DataFrame, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Pieces of items, a block at a time: rows reach the driver one by one."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    for name, text in rows.toLocalIterator():
        for piece in _pieces(name, bytes(text) if text is not None else None, window):
            held.append(piece)
            size += sum(map(len, piece[1]))
            if size >= BLOCK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


class Shard:
    """Texts in the vocabulary of a block, and the order of their suffixes."""

    def __init__(self, texts: list[bytes | None], block: Block):
        joined = b" \x00 ".join([(t or b"").translate(_LOWER) for t in texts] + [b""])
        tokens = joined.split()
        # words that the block lacks are 0, ends of texts -1
        get = {**block.numbers, _END: -1}.get
        found = np.fromiter((get(w, 0) for w in tokens), np.int64, len(tokens))
        ends = np.flatnonzero(found == -1)
        self.starts = np.r_[0, ends[:-1] + 1]
        self.n_words = ends - self.starts
        depth = int(block.left.max())
        self.words = np.r_[np.maximum(found, 0), np.zeros(depth + 1, np.int64)]
        known = np.flatnonzero(found > 0)
        stops = np.flatnonzero(self.words == 0)
        stop = stops[np.searchsorted(stops, np.arange(len(tokens)))] if len(tokens) else stops[:0]
        self.sa = sort_suffixes(self.words[: len(tokens)], known, stop, depth)
        counts = np.bincount(self.words[self.sa], minlength=len(block.numbers) + 2)
        self.first = np.cumsum(counts) - counts

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def _narrow(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, depth: int, above: bool):
        """The first place in ``low..high`` whose suffix has, after ``depth`` words, a
        word of at least ``word`` (``above``: a larger one)."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            there, want = self.words[self.sa[middle] + depth], word[open_]
            right = there <= want if above else there < want
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
            open_ = open_[low[open_] < high[open_]]
        return low

    def search(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """``(test suffixes, low, high, depth)``: the intervals of training suffixes
        that share ``depth`` words with them; given once a window is matched and
        again just before an interval narrows, so that every match is in an interval
        of its own length."""
        test = np.flatnonzero(block.need >= 0)
        low, high = self.first[block.words], self.first[block.words + 1]
        depth = 1
        while len(test):
            alive = low < high
            test, low, high = test[alive], low[alive], high[alive]
            window = block.need[test] == depth
            yield test[window], low[window], high[window], depth
            more = block.left[test] > depth
            a, b = low.copy(), low.copy()  # nothing matches beyond the end of an item
            word = block.words[test[more] + depth]
            a[more] = self._narrow(low[more], high[more], word, depth, False)
            b[more] = self._narrow(a[more], high[more], word, depth, True)
            last = (b - a < high - low) & (block.need[test] > 0) & (block.need[test] < depth)
            yield test[last], low[last], high[last], depth
            low, high, depth = a, b, depth + 1


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(np.unique(np.stack(columns), axis=1)) if len(columns[0]) else columns


def _matches(texts: list[bytes | None], block: Block) -> tuple[np.ndarray, list, list, np.ndarray]:
    """Words, merged spans, items and the longest match of each text."""
    shard = Shard(texts, block)
    cover = np.zeros(len(shard.words) + 1, np.int64)
    longest = np.zeros(len(texts), np.int64)
    pairs = [np.zeros(0, np.int64)]
    n_items = len(block.names)
    for test, low, high, depth in shard.search(block):
        window = block.need[test] == depth
        item = np.where(window, block.item[test], -1)
        item, low, high = _distinct(item, low, high)
        chunk = (np.cumsum(high - low) - (high - low)) // _CHUNK
        for c in np.unique(chunk).tolist():
            mine = chunk == c
            sizes = (high - low)[mine]
            places = shard.sa[spread(low[mine], sizes)]
            text, of = shard.text_of(places), np.repeat(item[mine], sizes)
            np.maximum.at(longest, text, depth)
            np.add.at(cover, places[of >= 0], 1)
            np.add.at(cover, places[of >= 0] + depth, -1)
            pairs.append(np.unique(text[of >= 0] * n_items + of[of >= 0]))
    covered = np.cumsum(cover) > 0
    edge = np.flatnonzero(np.diff(np.r_[False, covered].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    # adjoining texts are kept apart by their end marks, which no match covers
    owner = shard.text_of(begin)
    spans: list[list] = [[] for _ in texts]
    for t, a, b in zip(owner.tolist(), (begin - shard.starts[owner]).tolist(), (end - shard.starts[owner]).tolist()):
        spans[t].append((a, b))
    items: list[list] = [[] for _ in texts]
    for pair in np.unique(np.concatenate(pairs)).tolist():
        items[pair // n_items].append(block.names[pair % n_items])
    return shard.n_words, spans, items, longest


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search_block(text: Column, before: Column, pieces: Broadcast, window: int) -> Column:
    name = uuid.uuid4().hex

    def of(texts: pa.Array, found: pa.Array) -> pa.Array:
        block = _loaded(name, pieces, window)
        rows: list[dict] = []
        for a, b in text_slices(texts, SHARD_BYTES):
            columns = _matches(texts.slice(a, b - a).cast(pa.binary()).to_pylist(), block)
            for n_words, spans, items, longest, old in zip(*columns, found.slice(a, b - a).to_pylist()):
                if old is not None:
                    spans = _merged(spans + [(s["start"], s["end"]) for s in old["spans"]])
                    items, longest = {*items, *old["items"]}, max(longest, old["longest"])
                spans = [{"start": s, "end": e} for s, e in spans]
                rows.append({"n_words": n_words, "spans": spans, "items": sorted(items), "longest": longest})
        return pa.array(rows, _MATCHES)

    return F.arrow_udf(of, MATCHES)(text, before)


def with_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(row, found)``: ``row`` has all columns of each row, ``found`` is a struct of its
    number of words, the merged spans of words that belong to a match, the ids of
    the items that match, sorted as strings, and the length of the longest verbatim
    match (0: none reaches a window)."""
    if not 0 < window <= PIECE_WORDS:
        raise ValueError(f"a window has 1 to {PIECE_WORDS} words")
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    found = rows.withColumn("found", F.lit(None).cast(MATCHES))
    sent: Broadcast | None = None
    for pieces in _blocks(benchmark, window):
        if sent is not None:  # one block is with the tasks at a time
            found = stage(found, "decontaminate")
            sent.unpersist()
        sent = spark.sparkContext.broadcast(pieces)
        found = found.select("row", _search_block(F.col("row.text"), F.col("found"), sent, window).alias("found"))
    if sent is None:
        sent = spark.sparkContext.broadcast([("", [_END])])  # matches nothing
        found = found.select("row", _search_block(F.col("row.text"), F.col("found"), sent, window).alias("found"))
    return found


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items, longest, contaminated)`` of each row."""
    size = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return with_matches(docs.select("doc_id", "text"), benchmark, window).select(
        "row.doc_id",
        "found.n_words",
        size.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        "found.items",
        "found.longest",
        (F.size("found.spans") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns."""
    return with_matches(docs, benchmark, window).where(F.size("found.spans") == 0).select("row.*")
