"""Small building blocks over Columns: binding, deterministic hashes, vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Catalyst may inline a column into a filter or a lambda and then evaluate it
    once per use; binding it to a lambda variable keeps it at once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_hex(seed: int | str, *parts: Column) -> Column:
    """md5 (32 hex digits) of ``seed|part|part…``: the source of all randomness.

    It depends on the row alone, so results survive repartitioning, retries and
    lost executors, unlike ``rand(seed)``.
    """
    return F.md5(
        F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    )


def hash_u32(hex_hash: Column) -> Column:
    """The first 8 hex digits as an integer in [0, 2^32)."""
    return F.conv(F.substring(hex_hash, 1, 8), 16, 10).cast("bigint")


def fraction_bound(fraction: float) -> int:
    """The smallest integer in [0, 2^32] that is not below ``fraction`` of 2^32."""
    if fraction >= 1.0:
        return 2**32
    return -(-int(fraction * 2**52) // 2**20) if fraction > 0 else 0


def below_fraction(hex_hash: Column, fraction: float) -> Column:
    """True for ``fraction`` of all hashes: hash / 2^32 < fraction."""
    if fraction >= 1.0:
        return F.lit(True)
    # hex strings of equal length compare like the numbers they stand for
    return F.substring(hex_hash, 1, 8) < F.lit(f"{fraction_bound(fraction):08x}")


def scale_index(u32: Column, n: Column) -> Column:
    """floor(u / 2^32 * n): a uniform index in [0, n)."""
    return F.shiftright(u32 * n.cast("bigint"), 32)


def argmax(vector: Column) -> Column:
    """Position (from 0) of the largest entry, the first one on ties."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def softmax(vector: Column) -> Column:
    def normalise(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
        return let(total, lambda s: F.transform(exps, lambda x: x / s))

    def exponentiate(v: Column) -> Column:
        return let(
            F.array_max(v),
            lambda top: F.transform(v, lambda x: F.exp(x - top)),
        )

    return let(let(vector, exponentiate), normalise)


def mean_vectors(vectors: list[Column]) -> Column:
    """Element-wise mean of several vectors on the same row."""
    total = vectors[0]
    for v in vectors[1:]:
        total = F.zip_with(total, v, lambda a, b: a + b)
    return F.transform(total, lambda x: x / F.lit(float(len(vectors))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def micro(x: Column) -> Column:
    """A score as an integer number of millionths (exact sums and comparisons)."""
    return F.round(x * F.lit(1_000_000.0)).cast("bigint")
