"""Collocations: frequent phrases, mined by Toivonen's sampling.

Phrases of one to ``max_words`` words are frequent in a language if they occur at least
``min_count`` times. A sample of the documents (one of ``SAMPLE``, by hash) proposes the
phrases that are frequent in it at a lowered threshold. One full pass then counts the
proposed phrases and their negative border: every phrase that is not proposed although
the phrases without its first and without its last word are (of single words, every
one). The border is not listed; the pass counts it where it occurs, under a 64-bit hash.
A border phrase can only be frequent if its hash occurs often enough.

A phrase that was not counted holds a border phrase, and is frequent only if that
one is. So if no border phrase can be frequent, the counts are complete. Otherwise an
expansion pass counts these border phrases by themselves, and every phrase that holds
one and was not counted before. Whatever is frequent has then been counted, for a
phrase that holds one of the new phrases holds the border phrase too; so one expansion
closes the set, and results do not depend on the sample.

The proposed phrases are sent to the tasks as a bitmap of ``2 ** BITS`` hashed places,
16 MB whatever their number. A phrase that shares its place, or its hash, with another
counts as proposed, or as a border phrase to look at, which costs time and changes no
result: counts that matter are kept by the phrase itself. Tasks add up the phrases of
``SLICE_BYTES`` of text before any shuffle; shuffles are sums by phrase or hash, so neither
a hot language nor a hot word is gathered.

Texts are lower-cased (A to Z) and split into pieces at ``.,;:!?`` and at line ends;
words are what lies between spaces and tabs. A null text is empty, a null language is
``und``. Ids are only hashed, so they may repeat or be null; repeated rows count as often
as they are there. Only ``doc_id``, ``lang`` and ``text`` are read, so other columns can't
clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmith.llm.common import Batches
from corpusmith.llm.suffixes import text_slices
from corpusmith.sources.staging import stage

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
SAMPLE = 16
BITS = 27
SLICE_BYTES = 1 << 20
# parts of a language that are ranked for themselves first
_SALTS = 64

# no UTF-8 text has this byte
_CUT = b"\xff"
_CUTS = {*b".,;:!?", *range(0x0A, 0x0E)}
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else _CUT[0] if b in _CUTS else 0x20 if b == 0x09 else b for b in range(256)
)
_ROWS = pa.schema(
    [
        ("lang", pa.string()),
        ("k", pa.int32()),
        ("phrase", pa.string()),
        ("hash", pa.int64()),
        ("n", pa.int64()),
    ]
)
_DDL = "lang string, k int, phrase string, hash long, n long"


class Level(NamedTuple):
    """The phrases of one length that are counted, with their occurrences."""

    at: np.ndarray  # where they occur
    of: np.ndarray  # the phrase there
    first: np.ndarray  # an occurrence of each phrase
    count: np.ndarray
    hash: np.ndarray


class Pieces:
    """The words of texts of one language, with a cut between pieces."""

    def __init__(self, lang: str, texts: list[bytes]):
        joined = _CUT.join(t.translate(_TABLE) for t in texts)
        tokens = joined.replace(_CUT, b" " + _CUT + b" ").split()
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        numbers[_CUT]  # the cut is number 0
        self.lang = lang
        self.ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
        numbers.default_factory = None  # a cycle, which would keep the words in memory
        seed = xxhash.xxh64_intdigest(lang.encode())
        digest = xxhash.xxh64_intdigest
        self.hashes = np.fromiter((digest(w, seed) for w in numbers), np.uint64, len(numbers))
        self.names = pa.array([w if w != _CUT else b"" for w in numbers], pa.binary())

    def hashed(self, first: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the phrases of ``k`` words at ``first``."""
        x = np.full(len(first), k, np.uint64)
        for i in range(k):
            x = (x ^ self.hashes[self.ids[first + i]]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        return x

    def words(self) -> Level:
        at = np.flatnonzero(self.ids > 0)
        return self._level(at, self.ids[at], 1)

    def longer(self, level: Level, chosen: np.ndarray, k: int) -> Level:
        """The phrases of ``k`` words both of whose parts of ``k - 1`` words are chosen."""
        mine = chosen[level.of]
        at, of = level.at[mine], level.of[mine]
        both = np.flatnonzero(at[1:] == at[:-1] + 1)
        return self._level(at[both], of[both] * (len(level.first) + 1) + of[both + 1], k)

    def listed(self, at: np.ndarray, k: int) -> Level:
        """The phrases of ``k`` words at the given places."""
        key = np.zeros(len(at), np.int64)
        for i in range(k):
            _, key = np.unique(key * (len(self.hashes) + 1) + self.ids[at + i], return_inverse=True)
        return self._level(at, key, k)

    def _level(self, at: np.ndarray, key: np.ndarray, k: int) -> Level:
        _, first, of, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        return Level(at, of, at[first], count, self.hashed(at[first], k))

    def rows(self, level: Level, k: int, which: np.ndarray) -> pa.RecordBatch:
        """Counts of some phrases of a level, by the phrase."""
        first = level.first[which]
        parts = [self.names.take(pa.array(self.ids[first + i])) for i in range(k)]
        phrase = (pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]).cast(pa.string())
        return self.batch(k, phrase, level.count[which])

    def batch(self, k: int, phrase: pa.Array, count: np.ndarray) -> pa.RecordBatch:
        n = len(phrase)
        lang, length = pa.array([self.lang] * n, pa.string()), pa.array(np.full(n, k, np.int32))
        hashes = pa.array(np.zeros(n, np.int64))
        return pa.RecordBatch.from_arrays([lang, length, phrase, hashes, pa.array(count)], schema=_ROWS)


def _by_hash(level: Level, which: np.ndarray) -> pa.RecordBatch:
    """Counts of some phrases of a level, by their hash."""
    n = int(which.sum())
    none, length = pa.nulls(n, pa.string()), pa.array(np.full(n, -1, np.int32))
    hashes = pa.array(level.hash[which].view(np.int64))
    return pa.RecordBatch.from_arrays([none, length, none, hashes, pa.array(level.count[which])], schema=_ROWS)


def _is_in(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _pieces_of(batch: pa.RecordBatch):
    for a, b in text_slices(batch.column("text"), SLICE_BYTES):
        groups: dict[str, list[bytes]] = {}
        part = batch.slice(a, b - a)
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
            groups.setdefault(lang, []).append(text)
        yield from (Pieces(*group) for group in groups.items())


def _levels(pieces: Pieces, known: np.ndarray, upto: int):
    """Each level of counted phrases, and which of them are known."""
    level = pieces.words()
    for k in range(1, upto + 1):
        if k > 1:
            level = pieces.longer(level, is_known, k)
        is_known = _is_in(known, level.hash)
        yield k, level, is_known


def _sampled_counts(texts: DataFrame, known: Broadcast, k: int) -> DataFrame:
    """By hash, counts of the phrases of ``k`` words whose shorter parts are known."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for pieces in _pieces_of(batch):
                for length, level, _ in _levels(pieces, known.value, k):
                    if length == k:
                        yield _by_hash(level, np.ones(len(level.first), bool))

    return _summed(texts, run)


def _count(texts: DataFrame, known: Broadcast, max_words: int) -> DataFrame:
    """``(lang, k, phrase, hash, n)``: counts of the known phrases, counts of the border
    by hash (``k = -1``), and the words of each language (``k = 0``)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for pieces in _pieces_of(batch):
                for k, level, is_known in _levels(pieces, known.value, max_words):
                    yield pieces.rows(level, k, is_known)
                    yield _by_hash(level, ~is_known)
                    if k == 1:
                        yield pieces.batch(0, pa.array([""]), np.array([len(level.at)]))

    return _summed(texts, run)


def _expand(texts: DataFrame, known: Broadcast, failed: Broadcast, max_words: int) -> DataFrame:
    """As ``_count``, of the border phrases that failed, and of the phrases that hold
    one and were not counted."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for pieces in _pieces_of(batch):
                size = len(pieces.ids)
                holds = np.zeros(size + 1, bool)  # has the phrase here a failed one in it?
                whole = np.r_[pieces.ids > 0, False]  # is there a phrase of this length?
                for k, level, is_known in _levels(pieces, known.value, max_words):
                    if k > 1:
                        whole = np.r_[whole[:-1] & whole[1:], False]
                        holds = np.r_[holds[:-1] | holds[1:], False] & whole
                        new = holds.copy()
                        new[level.at] = False
                        found = pieces.listed(np.flatnonzero(new), k)
                        yield pieces.rows(found, k, np.ones(len(found.first), bool))
                    hit = _is_in(failed.value, level.hash) & ~is_known
                    yield pieces.rows(level, k, hit)
                    holds[level.at[hit[level.of]]] = True

    return _summed(texts, run)


def _summed(texts: DataFrame, run) -> DataFrame:
    counted = texts.select("lang", "text").mapInArrow(run, _DDL)
    return counted.groupBy("lang", "k", "phrase", "hash").agg(F.sum("n").alias("n"))


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """The places of ``phrases`` as bits, put together by Spark from at most
    ``2 ** BITS / 32768`` rows of 4 KB."""
    place = F.shiftrightunsigned("hash", 64 - BITS) + 1  # Spark's buckets begin with 1
    rows = (
        phrases.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    )
    bits = np.zeros(((1 << BITS) // 32768, 4096), np.uint8)
    for bucket, part in rows.collect():
        bits[bucket - 1] = np.frombuffer(bytes(part), np.uint8)
    return bits.reshape(-1)


def _normal(docs: DataFrame) -> DataFrame:
    lang, text = F.coalesce(docs["lang"], F.lit("und")), F.coalesce(docs["text"], F.lit(""))
    return docs.select("doc_id", lang.alias("lang"), text.alias("text"))


def frequent_phrases(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, sample: int = SAMPLE
) -> tuple[DataFrame, DataFrame]:
    """``(lang, k, phrase, n)`` of all phrases with at least ``min_count`` occurrences, and
    ``(lang, n)``: the words of each language."""
    context, docs = docs.sparkSession.sparkContext, _normal(docs)
    lowered = max(2, min_count // (2 * sample))
    sampled = stage(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample)) == 0), "phrase-sample")
    proposed = np.zeros((1 << BITS) // 8, np.uint8)
    for k in range(1, max_words):
        sent = context.broadcast(proposed)
        counts = _sampled_counts(sampled, sent, k)
        proposed = proposed | _bitmap(counts.where(F.col("n") >= lowered))
        sent.unpersist()
    known = context.broadcast(proposed)
    wanted = (F.col("n") >= min_count) | (F.col("k") == 0)
    counted = stage(_count(docs, known, max_words).where(wanted), "phrases")
    frequent, failed = counted.where("k > 0"), counted.where("k = -1")
    if failed.head(1):
        border = context.broadcast(_bitmap(failed))
        more = stage(_expand(docs, known, border, max_words).where(wanted), "phrases")
        frequent = frequent.unionByName(more)
        border.unpersist()
    known.unpersist()
    return frequent.select("lang", "k", "phrase", "n"), counted.where("k = 0").select("lang", "n")


def _joined(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    top: int | None = TOP,
    sample: int = SAMPLE,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of the cut that scores lowest,
    ``n`` all words; the score is ``floor(1000 * a * n / (l * r))``. A phrase goes if a
    longer one that holds it occurs as often. ``top=None`` ranks all.
    """
    frequent, totals = frequent_phrases(docs, max_words, min_count, sample)
    phrases = frequent.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"))
    words, k = F.split("phrase", " "), F.col("k")
    # between a phrase and a longer one that occurs as often all lengths do so too
    inner = F.explode(F.array(_joined(words, 1, k - 1), _joined(words, 2, k - 1))).alias("phrase")
    inside = phrases.where("k > 2").select("lang", inner, "a").distinct()
    left = phrases.join(inside, ["lang", "phrase", "a"], "left_anti")
    cut = left.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), k - 1)).alias("cut"))
    cut = cut.select(
        "lang",
        "phrase",
        "a",
        "cut",
        _joined(words, 1, F.col("cut")).alias("head"),
        _joined(words, F.col("cut") + 1, k - F.col("cut")).alias("tail"),
    )
    heads = frequent.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = frequent.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    parts = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")

    def exact(x: Column, digits: int) -> Column:
        return x.cast(f"decimal({digits},0)")

    above = exact(1000 * F.col("a"), 19) * exact(F.col("n"), 18)
    below = exact(F.col("l"), 19) * exact(F.col("r"), 18)
    scored = parts.withColumns({"above": above, "below": below})
    best = (
        scored.groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct(F.expr("above div below").alias("score"), "cut", "l", "r")).alias("best"))
        .select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))
        place = F.row_number().over(W.partitionBy("lang", salt).orderBy(*order))
        best = best.withColumn("place", place).where(F.col("place") <= top)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = best.withColumn("rank", rank)
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
