"""Byte-level BPE by tree reduction.

A text is cut by the tokenizer's pattern, and each piece is encoded by itself.
A piece is encoded as a tree: each half for itself, then neighbours are joined.
Joining re-encodes a window of tokens around the boundary and widens it until the
tokens outside can't change. That is proven by pairs: a token sequence is the
encoding of its bytes exactly if every two neighbours (a, b) are, that is, if
encoding their bytes alone gives (a, b) again. So it is enough that the window's
first and last token get along with the neighbours outside. Joining is
associative, halves may be of any size, and a piece of a million letters costs
no more per letter than a short one.

Decoding concatenates the tokens' bytes, up a tree of the same kind.

Null and empty texts have no ids. Texts are encoded whole, whatever their
length. No special tokens are recognised.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from corpusmith.llm.common import per_document

LEAF = 16
_DIRECT = 64
_NONE = 1 << 62
_JOINED = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.leaf = leaf
        self._byte = [ranks[bytes([b])] for b in range(256)]
        # what each two tokens merge to; the key is first * size + second
        self._size = max(self.tokens) + 1
        self._merged = {
            a * self._size + b: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None
        }
        self._agree = lru_cache(maxsize=1 << 15)(self._agree_uncached)

    def encode_piece(self, piece: bytes) -> list[int]:
        # a piece that is a token as a whole is that token, mergeable or not
        whole = self.ranks.get(piece)
        return self.tree(piece) if whole is None else [whole]

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf:
            return self.merge(piece)
        middle = len(piece) // 2
        return self.join(self.tree(piece[:middle]), self.tree(piece[middle:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours together."""
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            inside = left[len(left) - i :] + right[:j]
            window = self.merge(b"".join(map(self.tokens.__getitem__, inside)))
            left_stays = i == len(left) or self._agree(left[-i - 1], window[0])
            right_stays = j == len(right) or self._agree(window[-1], right[j])
            if left_stays and right_stays:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if left_stays else 2 * i), (j if right_stays else 2 * j)

    def _agree_uncached(self, a: int, b: int) -> bool:
        return self.merge(self.tokens[a] + self.tokens[b]) == [a, b]

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until none is left."""
        if len(piece) > _DIRECT:
            return self._merge_long(piece)
        merged, size = self._merged.get, self._size
        parts = [self._byte[b] for b in piece]
        pairs = [merged(a * size + b, _NONE) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) != _NONE:
            at = pairs.index(best)
            parts[at : at + 2] = [best]
            del pairs[at]
            if at:
                pairs[at - 1] = merged(parts[at - 1] * size + best, _NONE)
            if at < len(pairs):
                pairs[at] = merged(best * size + parts[at + 1], _NONE)
        return parts

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs over a linked list of parts."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here, 0 once swallowed
        before = list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(start: int) -> None:
            middle = end[start]
            if middle < n and (rank := ranks.get(piece[start : end[middle]])) is not None:
                heapq.heappush(heap, (rank, start, end[middle]))

        for start in range(n - 1):
            offer(start)
        while heap:
            rank, start, stop = heapq.heappop(heap)
            middle = end[start]
            # stale offers: a part was swallowed, or one of the two has grown since
            if not middle or middle >= n or end[middle] != stop or ranks.get(piece[start:stop]) != rank:
                continue
            end[start], end[middle] = stop, 0
            if stop < n:
                before[stop] = start
            offer(start)
            if before[start] >= 0:
                offer(before[start])
        starts = [0]
        while end[starts[-1]] < n:
            starts.append(end[starts[-1]])
        return [ranks[piece[s : end[s]]] for s in starts]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= _JOINED:
            return b"".join(map(self.tokens.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


class ChunkCache:
    """Encode texts through a bounded cache of chunks.

    The pattern never matches across a single space before a visible character:
    it starts a new match there. So texts are cut at these spaces, which is quick,
    and only chunks not seen lately are encoded. ``encode_many`` returns the ids
    of its chunks in one sequence, and how many each chunk has.
    """

    # cuts when a space has other white space around it
    _CUT = regex.compile(r" (?=\S)")
    # white space after a space, in the widest sense
    _WIDE = re.compile(r" (?:\s|\Z)")

    def __init__(
        self,
        encode_many: Callable[[list[str]], tuple[Sequence[int], Sequence[int]]],
        entries: int = 400_000,
    ):
        self.encode_many = encode_many
        self.entries = entries
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        if not text:
            return b""
        parts = self._CUT.split(text) if self._WIDE.search(text) else text.split(" ")
        # the first chunk has no space before it and is not cached
        head, found = parts[0], list(map(self.cache.get, parts))
        found[0] = None
        parts[0] = None
        missing = list({p for p, f in zip(parts, found) if f is None} - {None})
        ids, counts = self.encode_many([head, *[" " + p for p in missing]])
        packed = np.asarray(ids, "<u4").tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        found[0] = packed[: ends[0]]
        if missing:
            new = {p: packed[a:b] for p, a, b in zip(missing, ends, ends[1:])}
            for i, f in enumerate(found):
                if f is None:
                    found[i] = new[parts[i]]
            if len(self.cache) + len(new) > self.entries:
                self.cache.clear()
            # long chunks hardly come again
            self.cache.update((p, f) for p, f in new.items() if len(p) <= 64)
        return b"".join(found)


def local_file(path: str) -> str:
    """``path``, or where Spark has put it if it was sent with ``addFile``."""
    return SparkFiles.get(path.removeprefix("spark-file:")) if path.startswith("spark-file:") else path


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tuple[ByteBpe, ChunkCache]:
    """One per Python worker, kept from task to task."""
    bpe, pieces = ByteBpe(read_ranks(local_file(path))), regex.compile(pattern)

    def encode_many(chunks: list[str]) -> tuple[list[int], list[int]]:
        ids: list[int] = []
        counts = []
        for chunk in chunks:
            before = len(ids)
            for piece in pieces.findall(chunk):
                ids += bpe.encode_piece(piece.encode())
            counts.append(len(ids) - before)
        return ids, counts

    return bpe, ChunkCache(encode_many)


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``(doc_id, ids)``, and ``decoded`` (the ids' bytes) if asked for.

    ``ids`` is binary: little-endian unsigned 32-bit integers. ``path`` names a
    rank file that every executor can read, or ``spark-file:name`` for one sent
    with ``addFile``.
    """

    def make():
        bpe, cache = _encoder(path, pattern)

        def columns(texts: pa.Array) -> list[pa.Array]:
            packed = [cache.encode(x.as_py()) for x in texts]
            out = [pa.array(packed, pa.binary())]
            if decoded:
                back = [bpe.decode(np.frombuffer(p, "<u4").tolist()) for p in packed]
                out.append(pa.array(back, pa.binary()))
            return out

        return columns

    return per_document(docs, make, "ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` from the ``ids`` of ``encode``; null ids are empty. Bytes
    that are not UTF-8 become U+FFFD."""
    packed = encoded.select("doc_id", encoded["ids"].alias("text"))
    id_type = packed.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = ByteBpe(read_ranks(local_file(path)))
        for batch in batches:
            texts = [
                bpe.decode(np.frombuffer(p or b"", "<u4").tolist()).decode(errors="replace")
                for p in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    return packed.mapInArrow(run, f"doc_id {id_type}, text string")
