"""Token ids in shards of raw payload, with keyed access.

A store is a table of shards in ascending order of ``doc_id`` (nulls first). A
shard holds the ids of its documents one after another as little-endian
integers (16 bits if the vocabulary allows, else 32), each document ended by
``end_id``, and the places where documents end. Its index maps a document's key
to its place in constant time: a minimal perfect hash gives the key a slot, and
the slot holds a fingerprint of the key, its first document and how many there
are. Keys that were never stored are turned away by the fingerprint, but for one
in 2^32.

The minimal perfect hash has levels of bits: on each level the keys left are
hashed into about two bits per key; keys that hit a bit alone stay there, the
others go on to the next level. A key's slot is the rank of its bit.

Shards are rows of a Parquet table, so Spark's commit protocol makes the store
whole or absent, on any file system, whatever executors are lost. A shard is
closed at ``shard_ids`` ids; only a document longer than that makes a larger one.

Null texts count as empty and are stored as the end id alone. Documents with
equal or null ids are all stored, side by side, ordered by their ids' bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmith.llm.byte_bpe import local_file
from corpusmith.llm.common import Batches, per_document
from corpusmith.sources.staging import new_path

SHARD_IDS = 1 << 20
_LEVELS = 40
# fixed values: the finaliser of SplitMix64
_STEP = 0x9E3779B97F4A7C15
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64(_STEP * (seed + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0..n-1 for n distinct unsigned 64-bit keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.ranks = np.cumsum(bits) - bits

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        for level in range(_LEVELS):
            if not len(keys):
                break
            size = 2 * len(keys) + 1
            place = (_hash(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            keys = keys[~alone[place]]
        if len(keys):
            raise ValueError("keys are not distinct")
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), bits.astype(np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of the keys it was not built from."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            place = (_hash(keys[left], level) % np.uint64(size)).astype(np.int64)
            place += self.starts[level]
            hit = self.bits[place] == 1
            out[left[hit]] = self.ranks[place[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return self.sizes.astype("<i8").tobytes() + np.packbits(self.bits.astype(bool)).tobytes()

    @classmethod
    def from_bytes(cls, levels: int, data: bytes) -> PerfectHash:
        sizes = np.frombuffer(data, "<i8", levels)
        packed = np.frombuffer(data, np.uint8, offset=8 * levels)
        bits = np.unpackbits(packed, count=int(sizes.sum())) if len(packed) else packed
        return cls(sizes, bits.astype(np.int64))


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, _LEVELS) >> np.uint64(32)).astype(np.uint32)


_SLOT = np.dtype([("mark", "<u4"), ("first", "<u4"), ("count", "<u4")])

_SHARD = pa.schema(
    [
        ("part", pa.int32()),
        ("no", pa.int32()),
        ("start_in_part", pa.int64()),
        ("n_ids", pa.int64()),
        ("n_null_keys", pa.int64()),
        ("first_key", pa.int64()),
        ("last_key", pa.int64()),
        ("width", pa.int32()),
        ("payload", pa.binary()),
        ("ends", pa.binary()),
        ("keys", pa.binary()),
        ("levels", pa.int32()),
        ("hash", pa.binary()),
        ("slots", pa.binary()),
    ]
)
_SHARD_DDL = (
    "part int, no int, start_in_part long, n_ids long, n_null_keys long, first_key long, "
    "last_key long, width int, payload binary, ends binary, keys binary, levels int, "
    "hash binary, slots binary"
)


def _shard_row(
    part: int, no: int, start: int, keys: list[int | None], ids: list[bytes], width: int
) -> pa.RecordBatch:
    known = np.array([k for k in keys if k is not None], np.int64)
    n_null = len(keys) - len(known)
    distinct, first, counts = np.unique(known, return_index=True, return_counts=True)
    unsigned = distinct.view(np.uint64)
    index = PerfectHash.build(unsigned)
    slots = np.zeros(len(distinct), _SLOT)
    at = index.slots(unsigned)
    slots["mark"][at] = _fingerprints(unsigned)
    slots["first"][at] = first + n_null
    slots["count"][at] = counts
    ends = np.cumsum([len(x) // width for x in ids])
    row = {
        "part": part,
        "no": no,
        "start_in_part": start,
        "n_ids": int(ends[-1]),
        "n_null_keys": n_null,
        "first_key": int(known[0]) if len(known) else None,
        "last_key": int(known[-1]) if len(known) else None,
        "width": width,
        "payload": b"".join(ids),
        "ends": ends.astype("<i8").tobytes(),
        "keys": known.astype("<i8").tobytes(),
        "levels": len(index.sizes),
        "hash": index.to_bytes(),
        "slots": slots.tobytes(),
    }
    return pa.RecordBatch.from_pylist([row], _SHARD)


class Shard:
    """One shard, opened."""

    def __init__(self, row: dict):
        self.row = row
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.ends = np.frombuffer(row["ends"], "<i8")
        self.ids = np.frombuffer(row["payload"], f"<u{row['width']}")
        self.index = PerfectHash.from_bytes(row["levels"], row["hash"])
        self.slots = np.frombuffer(row["slots"], _SLOT)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first document of each key and the number of its documents, 0 if absent."""
        unsigned = keys.astype(np.int64).view(np.uint64)
        at = self.index.slots(unsigned)
        found = at >= 0
        found[found] = self.slots["mark"][at[found]] == _fingerprints(unsigned[found])
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[found] = self.slots["first"][at[found]]
        count[found] = self.slots["count"][at[found]]
        return first, count

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, start in the shard, ids) of all documents, found by their keys."""
        n_null = self.row["n_null_keys"]
        distinct = np.unique(self.keys)
        first, count = self.find(distinct)
        yield from ((None, *self.document(i)) for i in range(n_null))
        for key, a, n in zip(distinct.tolist(), first.tolist(), count.tolist()):
            yield from ((key, *self.document(i)) for i in range(a, a + n))

    def document(self, i: int) -> tuple[int, np.ndarray]:
        start = int(self.ends[i - 1]) if i else 0
        return start, self.ids[start : int(self.ends[i])]


# how byte-level tokenizers cut a text
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# from here on what is a letter is left to the library
_BEYOND_LATIN = chr(0x250)
# byte-level models write bytes as letters: the printable ones of Latin-1 as they are,
# the others in order from U+0100 on
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_LETTERS = {b: 0x100 + i for i, b in enumerate(x for x in range(0x100) if x not in _PRINTABLE)}
_SPACE = chr(_LETTERS[0x20])


# the pieces never go across a single space before a visible character: a new one starts
# there. White space after a space, in the widest sense, makes that a closer question.
_CUT = regex.compile(r" (?=\S)")
_WIDE = re.compile(r" (?:\s|\Z)")


def cut(text: str) -> list[str]:
    """Chunks that are encoded by themselves, without the space before each but the first."""
    return _CUT.split(text) if _WIDE.search(text) else text.split(" ")


class PackedCache:
    """Encode texts through a bounded cache of chunks, as packed ids of ``width`` bytes.

    A new chunk of Latin letters and marks is cut into the tokenizer's pieces here, and they go to its
    model as they are, which is quicker than its whole chain of steps; other chunks
    take that chain (``encode_others``). When ``entries`` chunks are new, those of the
    round before go.
    """

    def __init__(
        self,
        tokenize: Callable[[str], list],
        encode_others: Callable[[str], list[int]],
        width: int,
        entries: int = 700_000,
    ):
        self.tokenize, self.encode_others = tokenize, encode_others
        self.width, self.entries = width, entries
        self.packed: dict[int, bytes] = {}  # of each id that has come up
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}  # marks, white space and words without a space

    def _pack(self, ids: list[int]) -> bytes:
        try:
            return b"".join(map(self.packed.__getitem__, ids))
        except KeyError:
            self.packed.update((i, i.to_bytes(self.width, "little")) for i in ids)
            return b"".join(map(self.packed.__getitem__, ids))

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha() and piece[0] == " ":
            letters = _SPACE + piece[1:]
        else:
            letters = piece.encode().decode("latin-1").translate(_LETTERS)
        return self._pack([token.id for token in self.tokenize(letters)])

    def _known(self, piece: str) -> bytes:
        if piece[0] == " " and len(piece) > 1:
            word = piece[1:]
            return self.cache.get(word) or self.older.get(word) or self._piece(piece)
        found = self.pieces.get(piece)
        if found is None:
            found = self._piece(piece)
            if len(self.pieces) > 100_000:
                self.pieces.clear()
            if len(piece) <= 64:
                self.pieces[piece] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        if max(chunk) >= _BEYOND_LATIN:
            return self._pack(self.encode_others(chunk))
        if chunk[0] == " " and chunk[1:].isalpha():
            return self._piece(chunk)
        return b"".join(map(self._known, _PIECES.findall(chunk)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        parts = cut(text)
        head, parts[0] = parts[0], ""
        found = list(map(self.cache.get, parts))
        # the first chunk has no space before it and is not cached
        found[0] = self.chunk(head) if head else b""
        if None in found:
            older, new = self.older, {}
            for i, f in enumerate(found):
                if f is None:
                    part = parts[i]
                    ids = new.get(part)
                    if ids is None:
                        new[part] = ids = older.get(part) or self.chunk(" " + part)
                    found[i] = ids
            if len(self.cache) + len(new) > self.entries:
                self.older, self.cache = self.cache, {}
            # long chunks hardly come again
            self.cache.update((p, f) for p, f in new.items() if len(p) <= 64)
        return b"".join(found)


@lru_cache(maxsize=2)
def _encoder(path: str, width: int) -> Callable[[str], bytes]:
    """One per Python worker, kept from task to task: packed ids of a text."""
    file = local_file(path)
    tokenizer, whole = Tokenizer.from_file(file), Tokenizer.from_file(file)
    # chunks are those of texts that hold no added token
    tokenizer.encode_special_tokens = True
    added = [token.content for token in whole.get_added_tokens_decoder().values()]

    def encode_others(chunk: str) -> list[int]:
        return tokenizer.encode(chunk, add_special_tokens=False).ids

    cache = PackedCache(tokenizer.model.tokenize, encode_others, width)

    def encode_text(text: str) -> bytes:
        # an added token ends the text before it, so white space is cut otherwise there
        if any(token in text for token in added):
            return np.array(whole.encode(text, add_special_tokens=False).ids, f"<u{width}").tobytes()
        return cache.encode(text)

    return encode_text


def encode(docs: DataFrame, path: str, end_id: int, width: int) -> DataFrame:
    """``(doc_id, ids)``: packed ids with the end id, ``width`` bytes each.

    ``path`` names a file of the tokenizers library with byte-level splitting.
    """

    def make():
        encode_text, end = _encoder(path, width), np.array([end_id], f"<u{width}").tobytes()

        def columns(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([encode_text(x) + end for x in texts.to_pylist()], pa.binary())]

        return columns

    return per_document(docs, make, "ids binary")


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    vocabulary: int = 50_257,
    shard_ids: int = SHARD_IDS,
) -> None:
    """Encode ``docs`` and write them as a store. Ids are encoded once and stored
    before they are put in order, which takes two passes over them."""
    spark = docs.sparkSession
    width = 2 if vocabulary <= 1 << 16 else 4
    encoded_path = new_path(spark, "token-ids")
    encoded = encode(docs.withColumn("doc_id", docs["doc_id"].cast("long")), tokenizer, end_id, width)
    encoded.write.option("compression", "zstd").parquet(encoded_path)
    # the hash spreads a hot or null id over several ranges
    key = ("doc_id", F.xxhash64("ids"), "ids")
    ordered = spark.read.parquet(encoded_path).repartitionByRange(*key[:2]).sortWithinPartitions(*key)

    def pack(batches: Batches) -> Batches:
        part, no, start, size = TaskContext.get().partitionId(), 0, 0, 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        for batch in batches:
            for key, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                keys.append(key)
                ids.append(packed.as_py())
                size += len(ids[-1]) // width
                if size >= shard_ids:
                    yield _shard_row(part, no, start, keys, ids, width)
                    no, start, size, keys, ids = no + 1, start + size, 0, [], []
        if keys:
            yield _shard_row(part, no, start, keys, ids, width)

    ordered.mapInArrow(pack, _SHARD_DDL).write.option("compression", "zstd").parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a store with ``start``, the number of ids before each.

    Shards know their start within their part; the parts' totals, one row per
    writing task, are added up and broadcast.
    """
    shards = spark.read.parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    start = (F.col("base") + F.col("start_in_part")).alias("start")
    return shards.join(F.broadcast(bases), "part").select(*shards.columns, start)


def read_documents(store: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document of an opened store."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                rows = [
                    (key, row["start"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for key, at, ids in Shard(row).documents()
                ]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return store.mapInArrow(read, ", ".join(f"{n} long" for n in names))


def look_up(store: DataFrame, keys: list[int]) -> DataFrame:
    """``(doc_id, start, ids array<long>)`` of the documents with the given keys.

    Only shards whose key range holds one of the keys are read.
    """
    wanted = np.array(sorted(set(keys)), np.int64)
    near = F.lit(False)
    for key in wanted.tolist():
        near = near | F.lit(key).between(F.col("first_key"), F.col("last_key"))

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                for key, first, count in zip(wanted.tolist(), *map(np.ndarray.tolist, shard.find(wanted))):
                    for i in range(first, first + count):
                        at, ids = shard.document(i)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([key], pa.int64()),
                                pa.array([row["start"] + at], pa.int64()),
                                pa.array([ids.tolist()], pa.list_(pa.int64())),
                            ],
                            ["doc_id", "start", "ids"],
                        )

    return store.where(near).mapInArrow(read, "doc_id long, start long, ids array<long>")
