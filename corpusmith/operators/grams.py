"""Hashed n-grams of texts as sparse vectors, batch by batch.

The vectors are those of MLlib's RegexTokenizer, NGram and HashingTF one after another,
which make an object of every character and of every n-gram. Here the tokens of some
texts stand in one buffer, single spaces between them, so that an n-gram is a stretch of
it, and all stretches are hashed together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasNumFeatures, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.arrow import bounded_runs

# texts are counted together up to so many characters and features, so that what is
# made of them stays in a core's cache
RUN = 1 << 17
# that of HashingTF
SEED = 42


def _mixed(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    return h ^ _rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint32(by) | x >> np.uint32(32 - by)


def murmur3(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """MurmurHash3 (x86, 32 bits) of each stretch of ``data``."""
    padded = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    # the four bytes from each place on
    fours = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)
    sizes = ends - starts
    h = np.full(len(starts), SEED, np.uint32)
    left, at = np.flatnonzero(sizes >= 4), 0
    while len(left):
        x = _mixed(h[left], fours[starts[left] + at])
        h[left] = _rotated(x, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        at += 4
        left = left[sizes[left] >= at + 4]
    tail = (sizes & 3).astype(np.uint32)
    rest = fours[ends - tail] & ((np.uint32(1) << tail * np.uint32(8)) - np.uint32(1))
    # an empty tail is zero and changes nothing
    h = _mixed(h, rest) ^ sizes.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return h ^ h >> np.uint32(16)


def _words(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer, and of each word its start, its end and the number of its text."""
    # Python's whitespace is that of profiles.WS
    parts = [" ".join(t.split()).encode() for t in texts]
    data = b" ".join(parts)
    inside = np.concatenate([[False], np.frombuffer(data, np.uint8) != 0x20, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    first = np.cumsum([0, *[len(p) + 1 for p in parts[:-1]]])
    return data, starts, ends, np.searchsorted(first, starts, "right") - 1


def _chars(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The same of each character."""
    data = " ".join("".join(texts)).encode()
    places = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    starts, spaces = places[::2], places[1::2]
    ends = np.append(spaces, len(data)) if len(starts) else spaces
    return data, starts, ends, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _counted(texts: list[str], unit: str, n: int, size: int) -> tuple[np.ndarray, ...]:
    """Of some texts: how many features each has, the features and their counts."""
    data, starts, ends, of = (_words if unit == "word" else _chars)([t.lower() for t in texts])
    grams = max(len(starts) - n + 1, 0)
    # n-grams end where their text does
    whole = np.flatnonzero(of[:grams] == of[n - 1 : n - 1 + grams])
    hashes = murmur3(data, starts[whole], ends[whole + n - 1]).view(np.int32)
    # the same for a power of two, and faster
    places = hashes & (size - 1) if size & (size - 1) == 0 else hashes % size
    counts = np.bincount(of[whole] * size + places, minlength=len(texts) * size)
    found = np.flatnonzero(counts)
    return np.bincount(found // size, minlength=len(texts)), found % size, counts[found]


def vectors(texts: pa.Array, unit: str, n: int, size: int) -> pa.Array:
    """The sparse vector of each text, in the form that MLlib stores; null is empty."""
    values = [t or "" for t in texts.to_pylist()]
    parts = [(np.zeros(0, np.int64),) * 3]
    for start, stop in bounded_runs([len(t) + size for t in values], RUN):
        parts.append(_counted(values[start:stop], unit, n, size))
    sizes, features, counts = (np.concatenate(x) for x in zip(*parts))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    lists = [
        pa.ListArray.from_arrays(offsets, pa.array(features.astype(np.int32))),
        pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.float64))),
    ]
    fixed = [pa.array(np.zeros(len(values), np.int8)), pa.array(np.full(len(values), size, np.int32))]
    return pa.StructArray.from_arrays([*fixed, *lists], ["type", "size", "indices", "values"])


class HashedGrams(
    Transformer, HasInputCol, HasOutputCol, HasNumFeatures, DefaultParamsReadable, DefaultParamsWritable
):
    """Counts of the ``n``-grams of lower-cased words or characters, hashed."""

    unit = Param(Params._dummy(), "unit", "word or char", typeConverter=TypeConverters.toString)
    n = Param(Params._dummy(), "n", "tokens of an n-gram", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, numFeatures=1 << 18, unit="word", n=1):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        unit, n, size = (self.getOrDefault(p) for p in (self.unit, self.n, self.numFeatures))

        def of(texts: pa.Array) -> pa.Array:
            return vectors(texts, unit, n, size)

        made = F.arrow_udf(of, VectorUDT())(F.col(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), made)
