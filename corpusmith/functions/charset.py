"""Sets of characters and the regexes that find them quickly.

Java tests the members of ``[...]`` one range after another, so a class with a
dozen ranges costs a dozen calls for every character that is *not* in it. Here
the Latin-1 members become a bit set, and an intersection keeps the other ranges
from being looked at for any Latin-1 character. The other ranges are halved again and
again by intersections, so that a character is compared with few of them.
"""

from __future__ import annotations

from dataclasses import dataclass

_LATIN1_END = 0x100
_LAST = 0x10FFFF
# so many ranges are compared one after another
_FEW = 3


@dataclass(frozen=True)
class CharSet:
    """Disjoint, sorted code-point ranges (both ends included)."""

    ranges: tuple[tuple[int, int], ...]

    @classmethod
    def of(cls, spec: str) -> CharSet:
        """``CharSet.of("A-Z0-9가-힣·")``: characters and ``a-b`` ranges."""
        found, i = [], 0
        while i < len(spec):
            is_range = spec[i + 1 : i + 2] == "-" and i + 2 < len(spec)
            hi = spec[i + 2] if is_range else spec[i]
            found.append((ord(spec[i]), ord(hi)))
            i += 3 if is_range else 1
        return cls._merged(found)

    @classmethod
    def chars(cls, text: str) -> CharSet:
        """Every character of ``text``, taken literally."""
        return cls._merged([(ord(c), ord(c)) for c in text])

    @classmethod
    def _merged(cls, ranges) -> CharSet:
        merged: list[tuple[int, int]] = []
        for lo, hi in sorted(ranges):
            if merged and lo <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
            else:
                merged.append((lo, hi))
        return cls(tuple(merged))

    def __or__(self, other: CharSet) -> CharSet:
        return self._merged(self.ranges + other.ranges)

    def __contains__(self, char: str) -> bool:
        return any(lo <= ord(char) <= hi for lo, hi in self.ranges)

    def complement(self) -> CharSet:
        gaps, start = [], 0
        for lo, hi in self.ranges:
            if lo > start:
                gaps.append((start, lo - 1))
            start = hi + 1
        if start <= _LAST:
            gaps.append((start, _LAST))
        return CharSet(tuple(gaps))

    def _latin1(self) -> str:
        return "".join(
            f"\\x{c:02x}"
            for lo, hi in self.ranges
            for c in range(lo, min(hi, _LATIN1_END - 1) + 1)
        )

    def _beyond(self) -> list[tuple[int, int]]:
        return [(max(lo, _LATIN1_END), hi) for lo, hi in self.ranges if hi >= _LATIN1_END]

    def klass(self) -> str:
        """Java regex character class."""
        low, high = self._latin1(), self._beyond()
        if not high:
            return f"[{low}]"
        return rf"[{low}[[^\x00-\xff]&&{_halved(high)}]]" if low else _halved(high)


def _span(lo: int, hi: int) -> str:
    return f"\\x{{{lo:x}}}-\\x{{{hi:x}}}"


def _halved(ranges: list[tuple[int, int]]) -> str:
    """A class of the ranges in which each half is only looked at for characters between
    its ends."""
    if len(ranges) <= _FEW:
        return f"[{''.join(_span(*r) for r in ranges)}]"
    middle = len(ranges) // 2
    halves = ranges[:middle], ranges[middle:]
    return f"[{''.join(f'[{_span(h[0][0], h[-1][1])}&&{_halved(h)}]' for h in halves)}]"
