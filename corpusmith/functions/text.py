"""String functions, all native Spark expressions (``Column -> Column``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmith.functions.charset import CharSet
from corpusmith.functions.columns import let
from corpusmith.profiles import WS, TextProfile

_WS_CHARS = "".join(chr(c) for lo, hi in WS.ranges for c in range(lo, hi + 1))

_REGEX_SPECIAL = set("\\^$.|?*+()[]{}-&~#")


def _escape(literal: str) -> str:
    return "".join("\\" + c if c in _REGEX_SPECIAL else c for c in literal)


# --- whitespace -------------------------------------------------------------


def strip(text: Column) -> Column:
    """Trim Unicode whitespace at both ends (``trim`` only knows U+0020)."""
    return F.btrim(text, F.lit(_WS_CHARS))


def remove_spaces(text: Column) -> Column:
    """Remove U+0020 and nothing else."""
    return F.replace(text, F.lit(" "), F.lit(""))


def double_spaces(text: Column) -> Column:
    """Words separated by exactly two spaces."""
    return F.regexp_replace(strip(text), f"{WS.klass()}+", "  ")


def tokens(text: Column) -> Column:
    """Whitespace-delimited tokens; no token for blank text, null for null."""
    return F.filter(F.split(text, f"{WS.klass()}+"), lambda t: t != "")


def token_pieces(text: Column) -> Column:
    """Tokens with the whitespace after them; joined they give the text back."""
    return F.split(text, f"(?<={WS.klass()})(?!{WS.klass()})(?!$)")


def count_matches(text: Column, pattern: str) -> Column:
    """How many characters the matches hold. A pattern that matches runs of characters
    makes one replacement per run."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _runs(klass: str) -> str:
    # possessive, so that no way back is kept for the characters of a run
    return f"{klass}++"


# --- soft noise -------------------------------------------------------------


def fold_ellipsis(text: Column) -> Column:
    return F.replace(text, F.lit("..."), F.lit("…"))


def soft_clean_text(text: Column) -> Column:
    """Null to empty, strip, then fold ellipses."""
    return fold_ellipsis(strip(F.coalesce(text, F.lit(""))))


def noise_chars(text: Column, profile: TextProfile) -> Column:
    """The noise characters of a text, joined; empty for null."""
    found = F.regexp_extract_all(text, F.lit(profile.noise_pattern), F.lit(0))
    return F.coalesce(F.array_join(found, ""), F.lit(""))


def soft_noise_ratio(text: Column, profile: TextProfile) -> Column:
    """Noise characters / all characters, 4 places half-even, null when empty.

    Null rather than NaN: Spark orders NaN above every number, so NaN would
    pass a ``> threshold`` filter.
    """
    def ratio(t: Column) -> Column:
        n = count_matches(t, profile.noise_runs)
        return F.bround(F.try_divide(n.cast("double"), F.length(t)), 4)

    return let(text, ratio)


# --- hard noise -------------------------------------------------------------


def remove_terms(text: Column, terms: Sequence[str]) -> Column:
    """Remove the terms one after another, in the order given."""
    return F.aggregate(
        F.array(*[F.lit(t) for t in terms]),
        text,
        # most texts lack most terms, and looking is cheaper than replacing
        lambda acc, term: F.when(
            F.contains(acc, term), F.replace(acc, term, F.lit(""))
        ).otherwise(acc),
    )


def remove_percent(text: Column) -> Column:
    """Remove ``%`` after a digit of any script."""
    return F.regexp_replace(text, r"(?<=\p{Nd})%", "")


def remove_signal(text: Column, profile: TextProfile) -> Column:
    """What is left after removing the characters that carry meaning."""
    return F.regexp_replace(text, f"{profile.signal.klass()}+", "")


def count_noise(text: Column, profile: TextProfile) -> Column:
    """Length of what ``remove_signal`` leaves."""
    return count_matches(text, _runs(profile.signal.complement().klass()))


def reduce_text(text: Column, profile: TextProfile) -> Column:
    """Spaces, allowed terms and digit percent signs removed."""
    return remove_percent(remove_terms(remove_spaces(text), profile.allowed_terms))


def hard_noise_ratio_plain(text: Column, profile: TextProfile) -> Column:
    """Noise ratio by definition: one pass over the text per allowed term."""
    return let(
        reduce_text(text, profile),
        lambda r: _ratio_or_zero(count_noise(r, profile), F.length(r)),
    )


def hard_noise_ratio(text: Column, profile: TextProfile) -> Column:
    """The same ratio, in a handful of passes over the text.

    Characters that occur in no term cut the text into pieces that term removal
    cannot reach across. A piece that holds no term of two or more characters
    only loses its one-character terms, which one regex counts. So the ordered
    removal runs on the remaining, *live*, pieces alone (a small part of the
    text), and their before/after difference corrects the counts. Scripts of many
    signal characters, as Hangul, are cut short before all that.
    """
    terms = profile.allowed_terms
    singles = CharSet.chars("".join(t for t in terms if len(t) == 1))
    single_runs = _runs(singles.klass())
    meaning_runs = _runs((profile.signal.complement() | singles).complement().klass())
    live_piece = _live_piece_pattern(terms)
    inner = _inner_pattern(profile)

    def ratio(counts: Column) -> Column:
        return _ratio_or_zero(counts["noise"], counts["total"])

    def measured(x: Column, left_out: Column = F.lit(0)) -> Column:
        """Noise, and the length, of what removing one-character terms leaves. The rest
        without signal is a small part of the text, so only one pass is over all of it."""

        def of_rest(rest: Column) -> Column:
            noise = F.length(F.regexp_replace(rest, single_runs, ""))
            total = F.length(x) - F.length(rest) + left_out
            return let(noise, lambda n: F.struct(n.alias("noise"), (total + n).alias("total")))

        return let(F.regexp_replace(x, meaning_runs, ""), of_rest)

    def corrected(all_: Column, live: Column) -> Column:
        def difference(before: Column, after: Column) -> Column:
            noise = all_["noise"] - before["noise"] + count_noise(after, profile)
            return _ratio_or_zero(noise, all_["total"] - before["total"] + F.length(after))

        return let(
            F.struct(measured(live).alias("before"), reduce_text(live, profile).alias("after")),
            lambda x: difference(x["before"], x["after"]),
        )

    def by_pieces(t: Column, left_out: Column = F.lit(0)) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(live_piece), F.lit(0))
        both = F.struct(measured(t, left_out).alias("all"), F.array_join(pieces, "\x00").alias("live"))
        return let(both, lambda x: F.when(x["live"] == "", ratio(x["all"])).otherwise(corrected(x["all"], x["live"])))

    def of_shorter(t: Column) -> Column:
        def by_shorter(s: Column) -> Column:
            return by_pieces(s, F.length(t) - F.length(s))

        return let(F.regexp_replace(t, *inner), by_shorter)

    return let(remove_spaces(text), of_shorter if inner else by_pieces)


def _ratio_or_zero(noise: Column, total: Column) -> Column:
    ratio = F.try_divide(noise.cast("double"), total)
    return F.when(total.isNotNull(), F.coalesce(ratio, F.lit(0.0)))


# a range of so many characters is a script's, whose stretches are worth cutting short
_SCRIPT = 1000


def _inner_pattern(profile: TextProfile) -> tuple[str, str] | None:
    """What to replace in stretches of a script's signal characters, and the one character
    to replace it with: from the first character that no term has to the last one.

    Terms need a character of another script, so what lies between holds none and is
    signal; the new character keeps the pieces on both sides apart. None where the
    profile has no such script.
    """
    wide = CharSet(tuple(r for r in profile.signal.ranges if r[0] > 0xFF and r[1] - r[0] >= _SCRIPT))
    used = CharSet.chars("".join(profile.allowed_terms))
    unused = (wide.complement() | used).complement()
    if not unused.ranges or any(all(c in wide for c in t) for t in profile.allowed_terms):
        return None
    end = unused.klass()
    return f"{end}(?:{wide.klass()}*{end})?", chr(unused.ranges[0][0])


def _live_piece_pattern(terms: Sequence[str]) -> str:
    """A maximal run of term characters that term or percent removal may change."""
    reachable = [t for t in terms if " " not in t]
    # no Hangul syllable is a digit; asking for its kind takes longer than for its place
    digits = "[[^\\x{ac00}-\\x{d7a3}]&&\\p{Nd}]"
    run = f"[{CharSet.chars(''.join(reachable) + '%').klass()}{digits}]"
    first_single = next((i for i, t in enumerate(reachable) if len(t) == 1), None)
    early = reachable[:first_single]
    late = reachable[first_single:] if first_single is not None else []
    # A term after a one-character term may form only once that one is gone;
    # a piece without the term's last character can never form it.
    triggers = {t[-1] for t in late if len(t) > 1} | {"%"}
    early = {t for t in early if len(t) > 1 and not triggers & set(t)}
    # a term that contains another term adds nothing to "holds a term"
    minimal = {t for t in early if not any(o != t and o in t for o in early)}
    rests: dict[str, list[str]] = {}
    for t in sorted(minimal):
        rests.setdefault(t[0], []).append(t[1:])
    # Group the terms by first character, a few characters per group, guarded by
    # the group's first and second characters: most positions fail on the guards
    # and never see the single terms.
    groups = [CharSet.chars("".join(triggers)).klass()]
    firsts = sorted(rests, key=lambda c: (ord(c) > 0xFF, -ord(c)))
    for i in range(0, len(firsts), 8):
        group = firsts[i : i + 8]
        options = "|".join(_term_branch(c, rests[c]) for c in group)
        seconds = CharSet.chars("".join(r[0] for c in group for r in rests[c])).klass()
        guard = CharSet.chars("".join(group)).klass() + seconds
        groups.append(f"(?={guard})(?:{options})")
    starts = CharSet.chars("".join(triggers | rests.keys())).klass()
    # most characters fail the first condition
    return f"(?={run})(?<!{run}){run}*?(?={starts})(?:{'|'.join(groups)}){run}*"


def _term_branch(first: str, rests: Sequence[str]) -> str:
    ends = "".join(r for r in rests if len(r) == 1)
    options = [CharSet.chars(ends).klass()] * bool(ends)
    options += [_escape(r) for r in rests if len(r) > 1]
    return f"{_escape(first)}(?:{'|'.join(options)})"


# --- cleaning and naive variants --------------------------------------------


def keep_allowed(text: Column, profile: TextProfile) -> Column:
    """Only the allowed runs, joined and stripped; empty for null."""
    runs = F.regexp_extract_all(text, F.lit(profile.keep_runs), F.lit(0))
    return strip(F.coalesce(F.array_join(runs, ""), F.lit("")))


def remove_special(text: Column, profile: TextProfile) -> Column:
    return F.regexp_replace(text, profile.plain.complement().klass(), "")


# fixed value: the quotation marks, commas and backslashes generated text loses
QUOTES = '"“”‘’«»„\\,'


def remove_quotes(text: Column) -> Column:
    return F.regexp_replace(text, CharSet.chars(QUOTES).klass(), "")


# --- generated text ---------------------------------------------------------


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match of a regex, null when there is none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.try_element_at(found, F.lit(-1))


def after_last(text: Column, marker: str) -> Column:
    """What follows the last marker; the whole text when there is none."""
    return F.substring_index(text, marker, -1)


# fixed value: the characters stripped from both ends of a generated title
TITLE_EDGES = "[]\"',"


def numbered_titles(block: Column) -> Column:
    """Titles of the leading numbered lines of a block, as an array.

    Reading stops at the first line that is not numbered; list numbers, outer
    whitespace, brackets and quotes go, and blank titles are left out.
    """
    ws = WS.klass()
    numbered = f"^{ws}*\\p{{Nd}}+\\.{ws}*([^\\n]*)"

    def leading(lines: Column) -> Column:
        stop = F.array_position(
            F.transform(lines, lambda x: x.rlike(numbered)), F.lit(False)
        )
        return F.when(stop == 0, lines).otherwise(
            F.slice(lines, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))
        )

    def title(line: Column) -> Column:
        return F.btrim(
            strip(F.regexp_extract(line, numbered, 1)), F.lit(TITLE_EDGES)
        )

    lines = let(F.split(strip(block), "\n"), leading)
    return F.filter(F.transform(lines, title), lambda t: t != "")
