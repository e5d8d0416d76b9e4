"""Character profiles: which characters count as signal and which as noise.

A profile bundles everything the isolation and cleaning operators need to know
about a language. ``KOREAN`` is the news-headline profile; ``LATIN`` applies
the same rules to Latin-script text.
"""

from __future__ import annotations

from dataclasses import dataclass

from corpusmith.functions.charset import CharSet

# Whitespace as Unicode-aware engines see it (Java's own \s is ASCII only).
WS = CharSet.of(
    "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values -----------------------------------------------------------
# Terms that are legitimate in a headline although they are not Hangul, digits
# or CJK. Removal is sequential, so the order is part of the value.
ALLOWED_TERMS: tuple[str, ...] = (
    "SERICEO", "APTLD", "K 시리즈", "KAIST", "MWC19", "NBIoT", "U파손도움",
    "VR·AR", "u3000", "갤럭시A9", "갤럭시S8", "아이폰XR", "태블릿PC",
    "ALCS", "ETRI", "FARC", "GSMA", "H7N9", "KISA", "OECD", "RCEP", "S400",
    "S500", "K시리즈", "T멤버십", "UCLA", "UEFA", "USTR", "WNBA", "ai.x",
    "e스포츠", "스마트X", "아이폰X", "67P", "75t", "ACM", "AFC", "APT", "ATM",
    "AWS", "AfD", "A매치", "B2B", "B52", "BMW", "BeY", "CBS", "CCO", "CEO",
    "CPU", "CSD", "DMZ", "EBS", "ELS", "EPL", "ETF", "F35", "FFP", "G20",
    "G20", "HDC", "IBK", "IBM", "ICT", "IPO", "IRP", "ISA", "IoT", "KAT",
    "KBO", "KBO", "KBS", "KEB", "KGC", "KTB", "K리그", "LGU", "LNG", "LPG",
    "LTE", "MBC", "MLB", "MMT", "MOU", "MVP", "MWC", "NBA", "NEW", "NHK",
    "NHN", "NSA", "N여행", "PVC", "RFA", "S10", "SBS", "SDI", "SKB", "SKT",
    "SKT", "SNS", "TBN", "TPP", "U19", "U20", "UAE", "UAR", "UCC", "URL",
    "USC", "V30", "V50", "V리그", "WON", "WTI", "WTO", "aix", "com", "iOS",
    "tbs", "채널A", "%P", "%p", "3D", "3Q", "5G", "A8", "AG", "AI", "AS", "Be",
    "CJ", "C조", "D8", "DB", "EM", "ES", "EU", "FA", "FC", "FK", "G6", "G7",
    "G8", "GB", "GS", "HF", "IC", "IP", "IS", "IT", "KB", "KT", "K리", "K콘",
    "LA", "LD", "LG", "LH", "LS", "ML", "MS", "NC", "NH", "NO", "OK", "PC",
    "PF", "PO", "PS", "RD", "S9", "SA", "SK", "ST", "SW", "S펜", "TI", "TK",
    "TV", "T맵", "VR", "VS", "WS", "X6", "XR", "kt", "vs", ",", ".", "m", "|",
    "·", "…", "⅔", "↑", "→", "↓", "↔", "∼", "③", "④", "ㆍ", "㎜", "㎝", "㎡",
    "＋", "ｍ", "2％",
)

# Noise-ratio bins, right-closed, lowest edge included: (upper edge, label).
GROUP_BINS: tuple[tuple[float, str], ...] = (
    (0.2, "0"), (0.3, "0.2"), (0.4, "0.3"), (0.5, "0.4"),
    (0.6, "0.5"), (0.7, "0.6"), (0.8, "0.7"), (1.0, "0.8+"),
)
# The same with a group of its own for ratio 0.
ZERO_GROUP_BINS: tuple[tuple[float, str], ...] = (
    (0.0, "0"), (0.2, "0-0.2"), (0.3, "0.2-0.3"), (0.4, "0.3-0.4"),
    (0.5, "0.4-0.5"), (0.6, "0.5-0.6"), (0.7, "0.6-0.7"), (1.0, "0.7+"),
)
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class TextProfile:
    """What counts as noise in one language.

    ``signal`` survives into the hard remainder as meaning, ``allowed`` is not
    noise in the soft ratio, ``keep_runs`` are the runs that noise filtering
    keeps, ``plain`` is what special-character removal keeps. Soft thresholds:
    ``soft_low < r <= soft_high`` is noisy, ``r <= soft_clean`` is clean.
    """

    name: str
    signal: CharSet
    allowed: CharSet
    isolated_capital_is_noise: bool
    keep_runs: str
    plain: CharSet
    allowed_terms: tuple[str, ...] = ALLOWED_TERMS
    soft_low: float = 0.1
    soft_high: float = 0.36
    soft_clean: float = 0.11

    @property
    def noise_pattern(self) -> str:
        """One noise character: an isolated capital or a disallowed character."""
        return self._noise(self.allowed.complement().klass())

    @property
    def noise_runs(self) -> str:
        """The same characters, disallowed ones in runs."""
        return self._noise(f"{self.allowed.complement().klass()}++")

    def _noise(self, disallowed: str) -> str:
        if self.isolated_capital_is_noise:
            return f"(?<![A-Z])[A-Z](?![A-Z])|{disallowed}"
        return disallowed


_WS_RUN = f"{WS.klass()}+"

# --- fixed values: the character classes of the two profiles ---------------
KOREAN = TextProfile(
    name="korean",
    signal=CharSet.of("가-힣0-9\u4e00-\u9fff"),
    allowed=CharSet.of("ㄱ-ㅎ가-힣\u4e00-\u9fff0-9A-Z\u2026·∼") | WS,
    isolated_capital_is_noise=True,
    keep_runs=f"[가-힣]+|[0-9]+|[A-Z]{{2,}}|[\u4e00-\u9fff]+|{_WS_RUN}",
    plain=CharSet.of("A-Za-z0-9가-힣 "),
)

LATIN = TextProfile(
    name="latin",
    signal=CharSet.of("A-Za-zÀ-ÿ0-9") | WS,
    allowed=CharSet.of("A-Za-zÀ-ÿ0-9") | WS,
    isolated_capital_is_noise=False,
    keep_runs=f"[A-Za-zÀ-ÿ]+|[0-9]+|{_WS_RUN}",
    plain=CharSet.of("A-Za-zÀ-ÿ0-9 "),
)
# ----------------------------------------------------------------------------
