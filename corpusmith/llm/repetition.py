"""Quality rules on repetition: how much of a text is said twice.

Words are runs of characters other than U+0020 and U+0009 to U+000D. For each
n-gram length a polynomial rolling hash over the words' numbers gives the
windows of a text; a window seen before is a duplicate. The coverage of a length
is the share of word characters inside windows that occur more than once.
Shorter lengths look at the single most frequent window instead, because
common pairs of words repeat in any text. Lines count as duplicates when an
earlier line is the same.

A text fails at once with fewer than ``min_words`` words or when more than half
of its words are in repeated 3-word windows. Else it fails when a coverage or
the share of symbols or duplicate lines passes its limit.

Null and empty texts have no words and fail. Each text is looked at whole and by
itself; rows are not shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.llm.common import per_document

SYMBOLS = "#*$%&|<>"
# fixed value: multiplier of the rolling hash, odd, taken from Knuth's MMIX generator
_MULTIPLIER = np.uint64(6364136223846793005)


@dataclass(frozen=True)
class Limits:
    """Shares of word characters above which a text fails."""

    min_words: int = 50
    # most frequent n-gram, by n
    top: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    # all n-grams that occur more than once, by n
    repeated: dict[int, float] = field(default_factory=lambda: {5: 0.40, 7: 0.35, 10: 0.30})
    lines: float = 0.30
    symbols: float = 0.10


def word_numbers(words: list[str]) -> np.ndarray:
    """Equal words get equal numbers, counted from 0."""
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))


def rolling_hashes(numbers: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of ``n`` words, from one prefix sum per power."""
    hashes = np.zeros(max(0, len(numbers) - n + 1), np.uint64)
    for i in range(n):
        hashes = hashes * _MULTIPLIER + (numbers[i : i + len(hashes)] + np.uint64(1))
    hashes ^= hashes >> np.uint64(29)
    return hashes


def exact_windows(numbers: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the windows of ``n`` words, equal only for equal windows."""
    width = int(numbers.max()).bit_length() if len(numbers) else 0
    if n * width <= 64:
        keys = numbers[: max(0, len(numbers) - n + 1)].copy()
        for i in range(1, n):
            keys = (keys << np.uint64(width)) | numbers[i : i + len(keys)]
        return keys
    keys = numbers
    for i in range(1, n):  # number the pairs (shorter window, next word) anew each time
        longer = np.stack([keys[: len(numbers) - i], numbers[i:]], axis=1)
        keys = np.unique(longer, axis=0, return_inverse=True)[1].reshape(-1).astype(np.uint64)
    return keys


def repeated_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur more than once, and how often."""
    ordered = np.sort(keys)
    if not (ordered[1:] == ordered[:-1]).any():
        return ordered[:0], np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    counts = np.diff(np.r_[starts, len(keys)])
    return ordered[starts[counts > 1]], counts[counts > 1]


def places_of(wanted: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``keys`` are in the sorted ``wanted``, and at which place there."""
    at = np.minimum(np.searchsorted(wanted, keys), max(0, len(wanted) - 1))
    found = wanted[at] == keys if len(wanted) else np.zeros(len(keys), bool)
    return found, at


def covered(repeated: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Which words lie in a window of ``n`` words marked as repeated."""
    steps = np.zeros(n_words + 1, np.int64)
    steps[: len(repeated)] += repeated
    steps[n : n + len(repeated)] -= repeated
    return np.cumsum(steps[:-1]) > 0


def measure(text: str, limits: Limits) -> tuple[int, int, int, int, int, bool, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    words = _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()
    n_words = len(words)
    n_symbols = sum(map(text.count, SYMBOLS))
    n_dup_lines, dup_line_chars = _duplicate_lines(text)
    if not n_words:
        return 0, 0, n_symbols, 0, 0, True, False
    sizes = np.fromiter(map(len, words), np.int64, n_words)
    chars = int(sizes.sum())
    numbers = word_numbers(words)
    repeat = 0
    if n_words >= 3:
        keys = exact_windows(numbers, 3)
        twice, _ = repeated_keys(keys)
        if len(twice):
            repeat = int(covered(places_of(twice, keys)[0], 3, n_words).sum())
    failed = n_words < limits.min_words or 100 * repeat > 50 * n_words
    kept = not failed and not (
        n_symbols > limits.symbols * chars
        or dup_line_chars > limits.lines * chars
        or _too_repetitive(numbers, sizes, chars, limits)
    )
    return n_words, chars, n_symbols, n_dup_lines, repeat, failed, kept


_WORD = re.compile("[^\x20\x09-\x0d]+")
# characters at which str.split() cuts although they belong to words here
_OTHER_SPACE = re.compile("[^\\S\x20\x09-\x0d]")


def _duplicate_lines(text: str) -> tuple[int, int]:
    """How many lines equal an earlier one, and their word characters."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0, 0
    seen: set[str] = set()
    count = chars = 0
    for line in lines:
        if line in seen:
            if n := sum(map(len, _WORD.findall(line))):
                count += 1
                chars += n
        else:
            seen.add(line)
    return count, chars


def _too_repetitive(
    numbers: np.ndarray, sizes: np.ndarray, chars: int, limits: Limits
) -> bool:
    ends = np.r_[0, np.cumsum(sizes)]
    for n, limit in limits.top.items():
        keys = rolling_hashes(numbers, n)
        twice, counts = repeated_keys(keys)
        # no window is longer than n of the longest words
        if not len(twice) or counts.max() * n * sizes.max() <= limit * chars:
            continue
        found, at = places_of(twice, keys)
        starts = np.flatnonzero(found)
        window = ends[starts + n] - ends[starts]
        if (counts[at[starts]] * window).max() > limit * chars:
            return True
    for n, limit in limits.repeated.items():
        keys = rolling_hashes(numbers, n)
        twice, _ = repeated_keys(keys)
        if not len(twice):
            continue
        inside = covered(places_of(twice, keys)[0], n, len(numbers))
        if sizes[inside].sum() > limit * chars:
            return True
    return False


_COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean"
)


def _measurer(limits: Limits) -> Callable[[], Callable[[pa.Array], list[pa.Array]]]:
    def make():
        def columns(texts: pa.Array) -> list[pa.Array]:
            rows = [measure(x.as_py(), limits) for x in texts]
            types = [pa.int64()] * 5 + [pa.bool_()] * 2
            values = zip(*rows) if rows else [()] * 7
            return [pa.array(v, t) for v, t in zip(values, types)]

        return columns

    return make


def quality_report(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document: its counts, the base verdict and ``kept``."""
    return per_document(docs, _measurer(limits), _COLUMNS)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""

    def verdicts(texts: pa.Array) -> pa.Array:
        return pa.array([measure(x.as_py() or "", limits)[-1] for x in texts], pa.bool_())

    passed = F.arrow_udf(verdicts, "boolean")(docs["text"])
    return docs.where(passed)
