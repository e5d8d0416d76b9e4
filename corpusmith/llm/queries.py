"""Each operator applied to the whole of its table, with production parameters.

SQL for those that SQL can express; the others are compared with brute force in
``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm import (
    byte_bpe,
    decontaminate,
    exact_dedup,
    licences,
    mixing,
    periodic_runs,
    phrases,
    pii,
    quality_model,
    repetition,
    simhash,
    token_store,
    unigram_count,
)
from corpusmith.llm.common import table
from corpusmith.sources.staging import new_path

LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 3, "domain3": 2}


def mixture(docs: DataFrame) -> tuple[dict[str, Column], DataFrame]:
    """The tree domain, language, source, and its weights. Sources belong to
    domains by number, and those of a language share its weight evenly."""
    number = F.regexp_extract(docs["source"], "([0-9]+)$", 1)
    domain = F.concat(F.lit("domain"), F.coalesce(F.try_to_number(number, F.lit("999999")), F.lit(0)).cast("long") % 4)
    levels = {"domain": domain, "lang": docs["lang"], "source": docs["source"]}
    rows = [([d], w) for d, w in DOMAIN_WEIGHTS.items()]
    rows += [([d, x], w) for d in DOMAIN_WEIGHTS for x, w in LANGUAGE_WEIGHTS.items()]
    return levels, docs.sparkSession.createDataFrame(rows, "path array<string>, weight long")


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    levels, weights = mixture(docs)
    return mixing.mix_report(docs, levels, weights=weights)


def bpe_digests(encoded: DataFrame) -> list[Column]:
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return [
        n_tokens.alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, folder, "documents")
    encoded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return encoded.select("doc_id", *bpe_digests(encoded))


def op3_token_store(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "token-store")
    docs = table(spark, folder, "documents")
    token_store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_documents(token_store.open_store(spark, path))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    learned = labels.where(~quality_model.held_out(F.col("doc_id")))
    weights = quality_model.train(docs, learned)
    scored = quality_model.score_documents(docs, weights)
    return scored.select(
        "doc_id",
        quality_model.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, folder, "documents"))


def op6_unigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return unigram_count.count_tokens(table(spark, folder, "documents"), model)


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.report(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *[f"n_{kind}" for kind in pii.KINDS],
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
    )


def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.quality_report(table(spark, folder, "documents"))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def periodic_tail(mark: int, n: int) -> np.ndarray | None:
    """In a tenth of the texts the words from place ``a`` on repeat the ``p`` words there."""
    if mark % 10:
        return None
    g = mark // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    mark = F.crc32(docs["doc_id"].cast("string"))
    found = periodic_runs.find_runs(docs, arrange=periodic_tail, mark=mark)
    # the longest, then the first, then that of the smallest period
    ranked = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    best = F.array_max(ranked)
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["col2"]).alias("start"),
        best["length"].alias("length"),
        (-best["col3"]).alias("period"),
        F.floor(1000 * best["length"] / -best["col3"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        "longest",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_byte_bpe,
        op3_token_store,
        op4_quality_classifier,
        op5_exact_dedup,
        op6_unigram_counts,
        op7_pii,
        op8_licences,
        op9_simhash,
        op10_quality_rules,
        op11_phrases,
        op12_periodic_runs,
        op13_decontaminate,
    )
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cases(column: str, weights: dict[str, int]) -> str:
    whens = " ".join(f"WHEN {_quoted(k)} THEN {w}" for k, w in weights.items())
    return f"CASE {column} {whens} ELSE 1 END"


def _divide_sql(level: int, parents: list[str], node: str, weight: str) -> str:
    """Two common table expressions that divide ``s<level - 1>`` among its children."""
    keys = ", ".join([*parents, node])
    group = "PARTITION BY " + ", ".join(f"c.{p}" for p in parents) if parents else ""
    budget = f"s{level - 1}.share AS budget"
    join = f"JOIN s{level - 1} USING ({', '.join(parents)})" if parents else "CROSS JOIN s0"
    order = f"{group} ORDER BY capacity / weight, c.path"
    path = "'[\"' || " + " || '\",\"' || ".join([*parents, node]) + " || '\"]'"
    return f"""
c{level} AS (
  SELECT *, {path} AS path, {weight}::HUGEINT AS weight FROM (
    SELECT {keys}, sum(4 * tokens)::HUGEINT AS capacity FROM leaves GROUP BY ALL)),
r{level} AS (
  SELECT c.*, {budget},
    s{level - 1}.share - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM c{level} c {join}),
f{level} AS (SELECT *, capacity * weights <= rest * weight AS filled FROM r{level}),
o{level} AS (
  SELECT *, budget - sum(CASE WHEN filled THEN capacity ELSE 0 END) OVER ({group}) AS over_,
    sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({group}) AS open,
    sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS upto
  FROM f{level} c),
s{level} AS (
  SELECT {keys}, path, CASE WHEN filled THEN capacity
    ELSE least(capacity, over_ * upto // open - over_ * (upto - weight) // open) END::HUGEINT AS share
  FROM o{level})"""


_WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, 'domain' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4) AS domain,
    lang, source, {_WORDS_SQL}::HUGEINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM d GROUP BY ALL),
s0 AS (SELECT sum(tokens)::HUGEINT AS share FROM d),
{_divide_sql(1, [], "domain", _cases("domain", DOMAIN_WEIGHTS))},
{_divide_sql(2, ["domain"], "lang", _cases("lang", LANGUAGE_WEIGHTS))},
{_divide_sql(3, ["domain", "lang"], "source", "1")},
plan AS (
  SELECT domain, lang, source, path, share // tokens AS passes, share % tokens AS rest
  FROM s3 JOIN leaves USING (domain, lang, source)),
ordered AS (
  SELECT doc_id, path, d.tokens, passes, rest, sum(d.tokens) OVER (
    PARTITION BY path
    ORDER BY md5('{mixing.SEED}|' || passes || '|' || path || '|' || doc_id), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM d JOIN plan USING (domain, lang, source)),
taken AS (SELECT *, greatest(0, least(tokens, rest - coalesce(before, 0))) AS part FROM ordered)
SELECT doc_id, path AS leaf, tokens::BIGINT AS tokens,
  (passes + CASE WHEN part > 0 THEN 1 ELSE 0 END)::BIGINT AS copies,
  (passes * tokens + part)::BIGINT AS tokens_taken
FROM taken
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM g
"""


# RE2 has no look-around: lines are judged one by one, and ends are marked and then split
_WS_CLASS = r"[ \t\n\x0B\f\r]"
_MARGIN = r"^[ \t/*#;]*"
_HOLDER_BEFORE = r"[Cc]opyright[ \t:]+(?:by[ \t]+)?"
_HOLDER_RULES = (
    rf"{_MARGIN}©",
    rf"{_MARGIN}(?i:copyright)[ \t:]*(?:\([cC]\)|©)",
    rf"{_MARGIN}(?i:copyright|\(c\))[ \t:,]+{licences.YEAR}",
    rf"{_MARGIN}(?i:all rights reserved)[.!]?[ \t\r*/]*$",
)


def _canonical_sql(text: str) -> str:
    rules = " OR ".join(f"regexp_matches(line, {_quoted(rule)})" for rule in _HOLDER_RULES)
    named = f"regexp_matches(line, {_quoted(f'{_MARGIN}{_HOLDER_BEFORE}[A-Z][a-z]')})"
    other = f"regexp_matches(line, {_quoted(f'{_MARGIN}{_HOLDER_BEFORE}(?:{licences.NO_HOLDER})')})"
    lines = (
        f"list_transform(string_split({text}, chr(10)), "
        f"lambda line: CASE WHEN {rules} OR ({named} AND NOT {other}) THEN '' ELSE line END)"
    )
    out = f"translate(array_to_string({lines}, chr(10)), '{licences.UPPER}', '{licences.LOWER}')"
    for spelling, one in licences.EQUIVALENTS.items():
        out = f"replace({out}, {_quoted(spelling)}, {_quoted(one)})"
    out = rf"regexp_replace({out}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')"
    return f"sha256(trim({out}, ' '))"


def _known_sql() -> str:
    notices = [(n, t) for group in (licences.KNOWN, licences.HEADERS) for n, of in group.items() for t in of]
    titles = [(n, t) for n, of in licences.TITLES.items() for t in of]
    listed = [", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in of) for of in (notices, licences.bodies(), titles)]
    return f"""notices(licence, t) AS (VALUES {listed[0]}),
bodies(licence, t) AS (VALUES {listed[1]}),
titles(licence, title) AS (VALUES {listed[2]}),
known AS (
  SELECT {_canonical_sql("t")} AS digest, min(licence) AS licence FROM (
    SELECT * FROM notices UNION ALL SELECT * FROM bodies
    UNION ALL SELECT licence, title || chr(10) || chr(10) || t FROM bodies JOIN titles USING (licence))
  GROUP BY 1)"""


OP8_SQL = rf"""
WITH {_known_sql()},
d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
cued AS (SELECT * FROM d WHERE regexp_matches(text, {_quoted(licences.CUE)})),
paragraphs AS (
  SELECT row_no, trim(p, ' ') AS p FROM (
    SELECT row_no, unnest(regexp_split_to_array(text, {_quoted(licences.PARAGRAPH_END)})) AS p FROM cued)
  WHERE regexp_matches(p, {_quoted(licences.CUE)})),
parted AS (
  SELECT row_no, p, string_split(regexp_replace(
    p, '([.!?]){_WS_CLASS}(?:{_WS_CLASS}|[/*#;])*', '\1' || chr(1), 'g'), chr(1)) AS cut
  FROM paragraphs),
units AS (
  SELECT row_no, unnest(string_split(
    regexp_replace(text, {_quoted(licences.SENTENCE_END)}, '\1' || chr(10), 'g'), chr(10))) AS unit FROM cued
  UNION ALL
  SELECT row_no, unit FROM (SELECT row_no, unnest(cut) AS unit FROM parted)
  WHERE regexp_matches(unit, '[0-9A-Za-z_][^\n]*\n(?s:.*)[0-9A-Za-z_]')
  UNION ALL
  SELECT row_no, p FROM parted WHERE len(list_filter(cut, lambda u: regexp_matches(u, '[0-9A-Za-z_]'))) > 1),
hits AS (
  SELECT row_no, count(*) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM (SELECT row_no, {_canonical_sql("unit")} AS digest FROM units
        WHERE regexp_matches(unit, {_quoted(licences.CUE)})) JOIN known USING (digest)
  GROUP BY row_no),
whole AS (SELECT row_no, doc_id, {_canonical_sql("text")} AS digest FROM d)
SELECT doc_id, digest, licence, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known USING (digest) LEFT JOIN hits USING (row_no)
"""

OP11_SQL = rf"""
WITH w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
n AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM (
    SELECT lang, k, unnest([words[i:i + k - 1] for i in range(1, len(words) - k + 2)]) AS phrase
    FROM w, range(1, {phrases.MAX_WORDS + 1}) AS ks(k))
  GROUP BY ALL HAVING count(*) >= {phrases.MIN_COUNT}),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, cut, l.a AS l, r.a AS r, n, 1000 * c.a * n // (l.a * r.a) AS score
  FROM f c, range(1, {phrases.MAX_WORDS}) AS cs(cut), f l, f r, n
  WHERE c.k > cut AND l.lang = c.lang AND r.lang = c.lang AND n.lang = c.lang
    AND l.phrase = c.phrase[1:cut] AND r.phrase = c.phrase[cut + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT DISTINCT lang, phrase[i:i + m - 1] AS phrase, a
  FROM f, range(2, {phrases.MAX_WORDS}) AS ms(m), range(1, {phrases.MAX_WORDS}) AS js(i)
  WHERE m < k AND i <= k - m + 1),
ranked AS (
  SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank
  FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND i.a = b.a))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
  n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {phrases.TOP}
"""

ORACLES: dict[str, str] = {
    "op1_mix_sources": OP1_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op8_licences": OP8_SQL,
    "op11_phrases": OP11_SQL,
}
