"""Personal data by weak supervision, in built-in functions only.

Base spans follow fixed patterns: e-mail and IP addresses, card numbers (14 to 19
digits that pass the Luhn check) and international phone numbers (10 to 15
digits). They always stay. Looser patterns propose more spans: addresses with the
signs spelled out, IPv6 addresses, phone numbers without a country, numbers grouped
like a card's, and secrets, which are what follows a key word and ``=`` or ``:``.

Five labelers vote on every candidate: its form, a gazetteer (top-level domains,
country codes, reserved networks, issuers, lengths of keys), the words before it, its
borders and its length. Expectation-maximisation (Dawid and Skene) estimates from
the votes of the whole corpus how far each labeler can be trusted. It is anchored:
base spans are true, matches of a base pattern that fail its check are not, and
only looser candidates are uncertain. Labelers are shared by all kinds, so that kinds
without failing matches, or with few candidates, learn from the others; how often a
looser candidate is true is estimated for each kind. With the probabilities it gives,
a naive Bayes classifier is trained on features of the spans; a looser span is
added if the classifier is sure of it and no other span is in its place.

Texts are read once; candidates with a little text around them are stored, and
everything else works on those. Votes are counted before they are gathered, at
most 480 patterns, so the estimates are a few rows. A text's spans are gathered by
document, which is no more than the text itself held.

Null texts count as empty and have no spans. Repeated rows get equal results,
ids may be null or repeat, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmith.functions.columns import let
from corpusmith.sources.staging import stage

KINDS = ("email", "ip", "card", "phone")
# those that only the method finds come last
ALL_KINDS = (*KINDS, "secret")
ROUNDS = 25
SURE = 0.9
_BUCKETS = 1024
_CONTEXT = 32

# Matches are found from the left, without overlap. A run of characters that could
# start a match is tried at its first character only, and repeats are possessive,
# so long runs take linear time; what is found is the same as without.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_KEY_WORD = "(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth)"
LOOSE = {
    "email": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({]at[\])}] ?[A-Za-z0-9-]{1,63}+"
        r"(?: ?(?:[\[({]dot[\])}]|\.) ?[A-Za-z0-9-]{1,63}+){1,6}+"
    ),
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "secret": (
        rf"(?<={_KEY_WORD}['\"]? {{0,2}}[:=] {{0,2}}['\"]?)(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{{8,256}}+=*+"
    ),
}
# what a text must have for a pattern to match at all
_NEEDS = {
    ("email", True): lambda t: F.contains(t, F.lit("@")),
    ("email", False): lambda t: t.rlike(r"[\[({]at[\])}]"),
    ("ip", True): lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    ("ip", False): lambda t: t.rlike(r":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"),
    # separators come one at a time, so 14 digits lie within 27 characters
    ("card", True): lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    ("card", False): lambda t: t.rlike(r"[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]"),
    ("phone", True): lambda t: F.contains(t, F.lit("+")),
    ("phone", False): lambda t: t.rlike(r"[0-9]{3}[.-][0-9]{4}"),
    ("secret", False): lambda t: t.rlike(rf"{_KEY_WORD}['\"]? {{0,2}}[:=]"),
}
# fixed values: gazetteers. Every two letters may be a country's domain; the others are
# those of general use
DOMAINS = (
    "com org net edu gov mil int arpa info biz name pro aero coop museum jobs mobi tel travel cat asia post "
    "app dev page blog shop site online store tech cloud xyz top club live news email"
).split()
# country calling codes as they are assigned, by zone
COUNTRY_CODE = (
    r"^(?:1|2(?:[07]|1[12368]|[2346][0-9]|5[0-8]|9[01789])|3(?:[0-469]|5[0-9]|7[0-9]|8[0-35-79])"
    r"|4(?:[013-9]|2[013])|5(?:[1-8]|0[0-9]|9[0-9])|6(?:[0-6]|7[02-9]|8[0-35-9]|9[0-2])|7"
    r"|8(?:[1246]|0[08]|5[02356]|7[08]|8[0-368])|9(?:[0-58]|6[0-8]|7[0-79]|9[2-68]))"
)
CUES = {
    "email": "mail|contact|write|kontakt|schreib|correo|courriel|contacto",
    "ip": r"\bip\b|host|server|address|adresse|direcci|client|login",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|\btel|call|fax|mobile|anruf|telefon|téléphone|appel|llame|contact",
    "secret": _KEY_WORD,
}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """From the right, every second digit counts double, with its digits added."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    worth = F.transform(
        places, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    )
    return F.aggregate(worth, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _is_valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # numbers may have any number of leading zeros
        parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(
            parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255")))
        )
    low, high = (14, 19) if kind == "card" else (10, 15)
    digits = _digits(match)
    fits = F.length(digits).between(low, high)
    return fits & passes_luhn(digits) if kind == "card" else fits


def _candidates(text: Column, kind: str, base: bool) -> Column:
    """Matches in order, each with the length of the text since the one before."""
    pattern = BASE[kind] if base else LOOSE[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def pair(matches: Column, gaps: Column) -> Column:
        return F.transform(
            matches,
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"),
                F.lit(base).alias("base"),
                i.alias("i"),
                F.length(gaps[i]).alias("gap"),
                m.alias("match"),
                F.right(gaps[i], F.lit(_CONTEXT)).alias("before"),
                F.left(gaps[i + 1], F.lit(1)).alias("after"),
            ),
        )

    both = let(F.struct(found.alias("m"), between.alias("g")), lambda s: pair(s["m"], s["g"]))
    return F.when(_NEEDS[kind, base](text), both)


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(row_no, doc_id)`` of all rows, and the candidate spans ``(row_no, kind,
    base, strict, start, stop, match, before, after)``; both are stored."""
    text = F.coalesce(docs["text"], F.lit(""))
    patterns = [(k, True) for k in BASE] + [(k, False) for k in LOOSE]
    found = [F.coalesce(_candidates(text, k, b), F.array()) for k, b in patterns]
    rows = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row_no"),
            docs["doc_id"].alias("doc_id"),
            F.concat(*found).alias("found"),
        ),
        "pii-found",
    )
    spans = rows.select("row_no", F.inline("found"))
    order = W.partitionBy("row_no", "kind", "base").orderBy("i")
    upto = F.sum(F.col("gap") + F.length("match")).over(order)
    valid = F.lit(False)
    for kind in KINDS:
        valid = F.when(F.col("kind") == kind, _is_valid(kind, F.col("match"))).otherwise(valid)
    placed = spans.select(
        "row_no",
        "kind",
        "base",
        (F.col("base") & valid).alias("strict"),
        (upto - F.length("match")).alias("start"),
        upto.alias("stop"),
        "match",
        "before",
        "after",
    )
    return rows.select("row_no", "doc_id"), stage(placed, "pii-spans")


def _votes() -> Column:
    """One bit for each of the five labelers."""
    kind, match, before = F.col("kind"), F.lower("match"), F.lower("before")
    digits = _digits(F.col("match"))
    domain = F.regexp_extract(match, r"([a-z0-9-]+)$", 1)
    well_formed = (
        F.when(kind == "email", match.rlike(r"(?:\.|[\[({]dot[\])}]) ?[a-z]{2,}$"))
        .when(kind == "ip", F.col("strict") | F.contains("match", F.lit(":")))
        .when(kind == "card", F.length(digits).between(14, 19) & passes_luhn(digits))
        .when(kind == "phone", F.col("strict") | (F.length(digits) == 10) & digits.rlike("^[2-9]"))
        .otherwise(match.rlike("[0-9]") & match.rlike("[a-z]") & (F.length("match") >= 16))
    )
    known = (
        F.when(kind == "email", domain.rlike("^[a-z]{2}$") | domain.isin(DOMAINS))
        .when(kind == "ip", ~match.rlike(r"^(?:0+|2[4-5][0-9]|22[4-9]|23[0-9])\."))
        .when(kind == "card", digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"))
        .when(kind == "phone", ~F.contains("match", F.lit("+")) | digits.rlike(COUNTRY_CODE))
        .otherwise(match.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?:sk|pk|ghp|gho|xox[abp]|akia).{12,})$"))
    )
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = F.when(kind == k, before.rlike(words)).otherwise(cue)
    free = ~before.rlike(r"[\p{L}\p{N}_]$") & ~F.col("after").rlike(r"[\p{L}\p{N}_]")
    length = (
        F.when(kind == "email", match.rlike(r"^[a-z0-9]") & (F.length(match) <= 64))
        .when(kind == "ip", F.length(match).between(7, 39) & ~before.rlike(r"(?:\bv|version) ?$"))
        .when(kind == "card", F.length(digits).isin(14, 15, 16, 19))
        .when(kind == "phone", F.length(digits).between(10, 13))
        .otherwise(F.length(match) >= 20)
    )
    votes = F.lit(0)
    for i, vote in enumerate((well_formed, known, cue, free, length)):
        votes = votes + F.when(vote, 1 << i).otherwise(0)
    return votes


_LABELERS = 5
# what is known of a candidate before any vote
_FALSE, _TRUE, _OPEN = 0, 1, 2


def _anchor() -> Column:
    return F.when(F.col("strict"), _TRUE).when(F.col("base"), _FALSE).otherwise(_OPEN)


def _posterior(votes: Column, prior: Column, state: Column) -> Column:
    yes, no = prior, 1.0 - prior
    for i in range(_LABELERS):
        voted = votes.bitwiseAND(F.lit(1 << i)) > 0
        yes = yes * F.when(voted, state["hit"][i]).otherwise(1.0 - state["hit"][i])
        no = no * F.when(voted, state["miss"][i]).otherwise(1.0 - state["miss"][i])
    return yes / (yes + no)


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + value(x))


def estimate(patterns: Column, rounds: int = ROUNDS) -> Column:
    """Expectation-maximisation in one row over ``array<struct<kind, anchor, votes, n>>``,
    kinds by their place in ``ALL_KINDS``: ``array<struct<kind, anchor, votes, p>>``."""

    def voted(bit: int):
        return lambda x: x["votes"].bitwiseAND(F.lit(bit)) > 0

    def rates(scored: Column, weight) -> Column:
        # one vote each way beforehand keeps the rates off 0 and 1
        return F.array(
            *[
                (_total(F.filter(scored, voted(1 << i)), weight) + 1.0)
                / (_total(scored, weight) + 2.0)
                for i in range(_LABELERS)
            ]
        )

    def belief(x: Column, state: Column) -> Column:
        told = _posterior(x["votes"], F.get(state["prior"], x["kind"]), state)
        return F.when(x["anchor"] == _OPEN, told).otherwise(x["anchor"].cast("double"))

    def score(state: Column) -> Column:
        return F.transform(
            patterns,
            lambda x: F.struct(
                x["kind"].alias("kind"),
                x["anchor"].alias("anchor"),
                x["votes"].alias("votes"),
                x["n"].cast("double").alias("n"),
                belief(x, state).alias("p"),
            ),
        )

    def right(x):
        return x["n"] * x["p"]

    def prior(scored: Column, kind: int) -> Column:
        mine = F.filter(scored, lambda x: (x["kind"] == kind) & (x["anchor"] == _OPEN))
        return let(mine, lambda m: (_total(m, right) + 1.0) / (_total(m, lambda x: x["n"]) + 2.0))

    def maximise(scored: Column) -> Column:
        return F.struct(
            F.array(*[prior(scored, k) for k in range(len(ALL_KINDS))]).alias("prior"),
            rates(scored, right).alias("hit"),
            rates(scored, lambda x: x["n"] * (1.0 - x["p"])).alias("miss"),
        )

    start = F.struct(
        F.array(*[F.lit(0.5)] * len(ALL_KINDS)).alias("prior"),
        F.array(*[F.lit(0.8)] * _LABELERS).alias("hit"),
        F.array(*[F.lit(0.2)] * _LABELERS).alias("miss"),
    )
    last = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), start, lambda state, _: let(score(state), maximise)
    )
    return let(last, lambda s: F.transform(score(s), lambda x: x.dropFields("n")))


def _features() -> Column:
    shape = F.regexp_replace(F.regexp_replace(F.lower("match"), "[a-z]+", "a"), "[0-9]", "0")
    word = F.regexp_extract(F.lower("before"), r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1)
    values = {
        "shape": shape,
        "length": F.length("match").cast("string"),
        "word": word,
        "border": F.concat(F.right("before", F.lit(1)), F.lit("|"), F.col("after")),
    }
    return F.array(
        *[
            F.pmod(F.xxhash64(F.lit(name), value), F.lit(_BUCKETS)).cast("int") + i * _BUCKETS
            for i, (name, value) in enumerate(values.items())
        ]
    )


def classify(spans: DataFrame) -> DataFrame:
    """``spans`` with ``p``, the final classifier's probability."""
    place = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind")).cast("int") - 1
    voted = stage(
        spans.select("*", place.alias("kind_no"), _anchor().alias("anchor"), _votes().alias("votes")), "pii-votes"
    )
    counts = voted.groupBy("kind_no", "anchor", "votes").agg(F.count(F.lit(1)).alias("n"))
    # at most 5 kinds x 3 anchors x 32 patterns of votes
    entry = F.struct(F.col("kind_no").alias("kind"), "anchor", "votes", "n")
    patterns = counts.agg(F.sort_array(F.collect_list(entry)).alias("patterns"))
    told = patterns.select(F.inline(estimate(F.col("patterns")))).withColumnRenamed("kind", "kind_no")
    beliefs = stage(told, "pii-beliefs")
    believed = voted.join(F.broadcast(beliefs), ["kind_no", "anchor", "votes"])
    described = believed.select("row_no", "kind", "base", "start", "p", F.explode(_features()).alias("f"))
    # a feature's counts start with one span, divided as the kind's spans are
    share = (F.sum("p") + 0.5) / (F.count(F.lit(1)) + 1.0)
    totals = believed.groupBy("kind").agg(share.alias("share"))
    counts = described.groupBy("kind", "f").agg(F.sum("p").alias("yes"), F.sum(1.0 - F.col("p")).alias("no"))
    weight = F.log((F.col("yes") + F.col("share")) / (F.col("no") + 1.0 - F.col("share")))
    prior = F.log(F.col("share") / (1.0 - F.col("share")))
    model = stage(
        counts.join(F.broadcast(totals), "kind").select("kind", "f", weight.alias("w"), prior.alias("prior")),
        "pii-model",
    )
    # at most 5 kinds x 4 features x 1024 buckets
    scores = (
        described.join(F.broadcast(model), ["kind", "f"])
        .groupBy("row_no", "kind", "base", "start")
        .agg((F.sum(F.col("w") - F.col("prior")) + F.max("prior")).alias("logit"))
        .select("row_no", "kind", "base", "start", (1.0 / (1.0 + F.exp(-F.col("logit")))).alias("p"))
    )
    return spans.join(scores, ["row_no", "kind", "base", "start"])


def settle(chosen: DataFrame) -> DataFrame:
    """``chosen (row_no, kind, start, stop, strict)`` without the looser spans that
    overlap a base span, or else an earlier looser span that stays."""
    row = W.partitionBy("row_no").orderBy("start", F.col("strict").desc(), "kind", "stop")
    before = row.rowsBetween(W.unboundedPreceding, -1)
    after = row.rowsBetween(1, W.unboundedFollowing)
    taken = F.max(F.when(F.col("strict"), F.col("stop"))).over(before) > F.col("start")
    ahead = F.min(F.when(F.col("strict"), F.col("start"))).over(after) < F.col("stop")
    fits = F.col("strict") | ~(F.coalesce(taken, F.lit(False)) | F.coalesce(ahead, F.lit(False)))
    left = chosen.select("row_no", "kind", "start", "stop", "strict", fits.alias("fits")).where("fits")
    # chains of overlapping spans are short, and settled each by itself
    side = W.partitionBy("row_no", "strict").orderBy("start", "kind", "stop")
    reached = F.max("stop").over(side.rowsBetween(W.unboundedPreceding, -1))
    begins = F.coalesce(reached <= F.col("start"), F.lit(True)).cast("int")
    numbered = left.withColumn("begins", begins).withColumn(
        "chain_no", F.sum("begins").over(side.rowsBetween(W.unboundedPreceding, 0))
    )
    span = F.struct("start", "kind", "stop")
    chains = numbered.groupBy("row_no", "strict", "chain_no").agg(F.sort_array(F.collect_list(span)).alias("chain"))
    first = F.struct(F.slice("chain", 1, 1).alias("kept"), F.col("chain")[0]["stop"].alias("end"))
    kept = F.aggregate(
        F.slice("chain", 2, F.size("chain")),
        first,
        lambda held, x: F.when(
            x["start"] >= held["end"],
            F.struct(F.concat(held["kept"], F.array(x)).alias("kept"), x["stop"].alias("end")),
        ).otherwise(held),
    )["kept"]
    spans = F.when(F.col("strict"), F.col("chain")).otherwise(kept)
    return chains.select("row_no", "strict", F.inline(spans)).select("row_no", "kind", "start", "stop", "strict")


def find_spans(docs: DataFrame, sure: float = SURE) -> tuple[DataFrame, DataFrame]:
    """``(row_no, doc_id)`` of all rows, and the final spans ``(row_no, kind, start,
    stop, strict)`` in code points, the end exclusive."""
    rows, spans = candidates(docs)
    # matches of a base pattern that fail its check are evidence, but never spans
    chosen = classify(spans).where(F.col("strict") | (~F.col("base") & (F.col("p") >= sure)))
    return rows, settle(chosen)


def report(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """One row per document: counts of base spans by kind, and all spans.

    ``base`` and ``spans`` are arrays of ``kind:start:end``, by start and kind.
    """
    rows, spans = find_spans(docs, sure)
    place = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind"))
    label = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("stop").cast("string"))
    item = F.struct("start", place.alias("place"), label.alias("label"), "strict", "kind")
    per_row = spans.groupBy("row_no").agg(F.sort_array(F.collect_list(item)).alias("items"))
    items = F.coalesce("items", F.array().cast(per_row.schema["items"].dataType))
    base = F.filter("items", lambda x: x["strict"])

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    joined = rows.join(per_row, "row_no", "left").withColumn("items", items).withColumn("base", base)
    return joined.select(
        "doc_id",
        *map(count, KINDS),
        F.transform("base", lambda x: x["label"]).alias("base"),
        F.transform("items", lambda x: x["label"]).alias("spans"),
    )
