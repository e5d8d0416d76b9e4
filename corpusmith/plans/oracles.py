"""DuckDB SQL for the query catalogue, written independently of the Spark code.

RE2 has no lookarounds and DuckDB no half-even rounding to places, so several
rules are phrased another way here.
"""

from __future__ import annotations

from corpusmith.operators.eda import EDA_SEED
from corpusmith.operators.relabel import RANK_SEED
from corpusmith.operators.sampling import ID_FORMAT, SPLIT_SEED
from corpusmith.operators.synth import (
    ANSWER_MARKER,
    FEW_SHOT_INSTRUCTION,
    LIST_MARKER,
    RECOVERY_INSTRUCTION,
)
from corpusmith.plans.inputs import HANGUL_LETTERS, LATIN_LETTERS, LINEAR
from corpusmith.profiles import ALLOWED_TERMS, GROUP_BINS, ZERO_GROUP_BINS
from corpusmith.sources.readers import NA_VALUES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WS_LIT = _q(_WS_CHARS)
WS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
LATIN = "A-Za-zÀ-ÿ0-9"
HANGUL = r"가-힣0-9\x{4e00}-\x{9fff}"
KOREAN_ALLOWED = r"ㄱ-ㅎ가-힣\x{4e00}-\x{9fff}0-9A-Z\x{2026}·∼" + WS

DOCS = """docs AS (
  SELECT doc_id, doc_id::VARCHAR AS row_key, doc_id::VARCHAR AS ID, text, lang,
         (n_chars % 7)::INTEGER AS target
  FROM documents)"""
KOREAN_DOCS = f"""docs AS (
  SELECT doc_id, doc_id::VARCHAR AS row_key, doc_id::VARCHAR AS ID,
         translate(text, '{LATIN_LETTERS}', '{HANGUL_LETTERS}') AS text, lang,
         (n_chars % 7)::INTEGER AS target
  FROM documents)"""
TURNS = """turns AS (
  SELECT conv_id || '#' || turn AS row_key, conv_id || '#' || turn AS ID, text,
         (conv_id % 7)::INTEGER AS target
  FROM conversations)"""
LABELLED = """corpus AS (
  SELECT doc_id::VARCHAR AS row_key, doc_id::VARCHAR AS ID, text,
         (quality + 2 * toxic)::INTEGER AS target
  FROM documents LEFT JOIN labels USING (doc_id))"""

ORACLES: dict[str, str] = {}


# --- noise --------------------------------------------------------------------


def _reduced(text: str) -> str:
    terms = ", ".join(_q(t) for t in ALLOWED_TERMS)
    removed = (
        f"list_reduce([{terms}], lambda acc, k: replace(acc, k, ''), "
        f"replace({text}, ' ', ''))"
    )
    return rf"regexp_replace({removed}, '(\p{{Nd}})%', '\1', 'g')"


def _hard(signal: str) -> str:
    return f"""reduced AS (SELECT *, {_reduced('text')} AS r FROM docs),
measured AS (
  SELECT * EXCLUDE (r),
         CASE WHEN length(r) = 0 THEN 0.0::DOUBLE
              ELSE length(regexp_replace(r, '[{signal}]', '', 'g'))::DOUBLE / length(r)
         END AS noise_ratio
  FROM reduced)"""


LATIN_HARD = f"WITH {DOCS}, {_hard(LATIN + WS)}"
KOREAN_HARD = f"WITH {KOREAN_DOCS}, {_hard(HANGUL)}"

ORACLES["hard_noise_ratio"] = f"{LATIN_HARD} SELECT doc_id, noise_ratio FROM measured"
ORACLES["hard_noise_ratio_korean"] = (
    f"{KOREAN_HARD} SELECT doc_id, noise_ratio FROM measured"
)
ORACLES["remove_allowed_terms"] = (
    f"WITH {DOCS} SELECT doc_id, {_reduced('text')} AS reduced FROM docs"
)


def _bin_number(bins) -> str:
    cases = " ".join(f"WHEN noise_ratio <= {hi} THEN {i}" for i, (hi, _) in enumerate(bins))
    return f"CASE {cases} END"


def _histogram(source: str, bins) -> str:
    labels = ", ".join(f"({i}, {_q(name)})" for i, (_, name) in enumerate(bins))
    return f"""{source}
SELECT b.bin_no::INTEGER AS bin_no, b.noise_group, count(m.doc_id)::BIGINT AS n_rows
FROM (VALUES {labels}) AS b(bin_no, noise_group)
LEFT JOIN (SELECT doc_id, {_bin_number(bins)} AS bin_no FROM measured) m
  ON m.bin_no = b.bin_no
GROUP BY 1, 2"""


ORACLES["noise_histogram"] = _histogram(KOREAN_HARD, GROUP_BINS)
ORACLES["noise_histogram_zero_group"] = _histogram(LATIN_HARD, ZERO_GROUP_BINS)
_group_names = ", ".join(_q(name) for _, name in GROUP_BINS)
ORACLES["noise_groups"] = f"""{LATIN_HARD}
SELECT doc_id, ([{_group_names}])[{_bin_number(GROUP_BINS)} + 1] AS noise_group
FROM measured"""
ORACLES["isolate_hard_noisy"] = (
    f"{LATIN_HARD} SELECT ID, text, target FROM measured WHERE noise_ratio > 0"
)
ORACLES["isolate_hard_clean"] = (
    f"{LATIN_HARD} SELECT ID, text, target FROM measured WHERE noise_ratio = 0"
)

_CLEAN = f"replace(trim(coalesce(text, ''), {WS_LIT}), '...', '…')"


def _soft(noise_count: str) -> str:
    return f"""cleaned AS (SELECT * EXCLUDE (text), {_CLEAN} AS text FROM docs),
measured AS (
  SELECT *, CASE WHEN length(text) > 0
    THEN round_even(({noise_count})::DOUBLE / length(text) * 10000, 0) / 10000
    END AS noise_ratio
  FROM cleaned)"""


_latin_noise = f"length(regexp_replace(text, '[{LATIN}{WS}]', '', 'g'))"
# isolated capitals are runs of exactly one capital
_korean_noise = f"""length(regexp_replace(text, '[{KOREAN_ALLOWED}]', '', 'g'))
  + len(list_filter(regexp_extract_all(text, '[A-Z]+'), lambda z: length(z) = 1))"""
LATIN_SOFT = f"WITH {DOCS}, {_soft(_latin_noise)}"
KOREAN_SOFT = f"WITH {KOREAN_DOCS}, {_soft(_korean_noise)}"

ORACLES["soft_noise_ratio"] = f"{LATIN_SOFT} SELECT doc_id, noise_ratio FROM measured"
ORACLES["soft_noise_ratio_korean"] = (
    f"{KOREAN_SOFT} SELECT doc_id, noise_ratio FROM measured"
)
ORACLES["noise_characters"] = f"""WITH {DOCS}
SELECT doc_id, regexp_replace({_CLEAN}, '[{LATIN}{WS}]', '', 'g') AS non_kor FROM docs"""
ORACLES["isolate_soft_noisy"] = f"""{LATIN_SOFT}
SELECT ID, text, target FROM measured WHERE noise_ratio > 0.1 AND noise_ratio <= 0.36"""
ORACLES["isolate_soft_clean"] = f"""{LATIN_SOFT}
SELECT ID, text, target FROM measured WHERE noise_ratio <= 0.11"""


def _summary(mode: str, source: str, noisy: str, clean: str) -> str:
    n, c = f"coalesce({noisy}, false)", f"coalesce({clean}, false)"
    return f"""SELECT '{mode}' AS mode, count(*) AS n_rows,
  count(*) FILTER ({n}) AS n_noisy, count(*) FILTER ({c}) AS n_clean,
  count(*) FILTER ({n} AND {c}) AS n_both,
  count(*) FILTER (NOT {n} AND NOT {c}) AS n_neither,
  count(*) FILTER (noise_ratio IS NULL) AS n_rejected
FROM ({source} SELECT noise_ratio FROM measured)"""


ORACLES["isolation_summary"] = (
    _summary("hard", LATIN_HARD, "noise_ratio > 0", "noise_ratio = 0")
    + " UNION ALL "
    + _summary(
        "soft",
        LATIN_SOFT,
        "noise_ratio > 0.1 AND noise_ratio <= 0.36",
        "noise_ratio <= 0.11",
    )
)

# --- cleaning and augmentation ---------------------------------------------------


def _variants(docs: str, texts: dict[str, str], source: str = "docs") -> str:
    parts = [
        f"SELECT row_key || '#{kind}' AS row_key, ID, {text} AS text, target, "
        f"'{kind}' AS aug_kind FROM {source}"
        for kind, text in texts.items()
    ]
    return f"WITH {docs} " + " UNION ALL ".join(parts)


def _filtered(keep: str) -> str:
    runs = f"regexp_extract_all(coalesce(text, ''), '{keep}')"
    return f"trim(array_to_string({runs}, ''), {WS_LIT})"


_latin_keep = f"[A-Za-zÀ-ÿ]+|[0-9]+|[{WS}]+"
_korean_keep = rf"[가-힣]+|[0-9]+|[A-Z]{{2,}}|[\x{{4e00}}-\x{{9fff}}]+|[{WS}]+"
ORACLES["noise_filter_text"] = _variants(DOCS, {"filtered": _filtered(_latin_keep)})
ORACLES["noise_filter_korean"] = _variants(
    KOREAN_DOCS, {"filtered": _filtered(_korean_keep)}
)


def _naive(plain: str) -> dict[str, str]:
    return {
        "original": "text",
        "plain": f"regexp_replace(text, '[^{plain}]+', '', 'g')",
        "lower": "lower(text)",
        "spaced": f"regexp_replace(trim(text, {WS_LIT}), '[{WS}]+', '  ', 'g')",
    }


LATIN_NAIVE = _naive("A-Za-zÀ-ÿ0-9 ")
ORACLES["naive_variants"] = _variants(DOCS, LATIN_NAIVE)
ORACLES["naive_variants_korean"] = _variants(KOREAN_DOCS, _naive("A-Za-z0-9가-힣 "))


def _tokens(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array({text}, '[{WS}]+'), lambda x: x <> '')"
    )


def _exploded(source: str, name: str = "tok") -> str:
    return f"""arr AS (SELECT row_key, ID, target, {_tokens('text')} AS toks FROM {source}),
{name} AS (
  SELECT row_key, ID, target, len(toks) AS l, greatest(1, floor(len(toks) * 0.1::DOUBLE))::BIGINT AS k,
         unnest(range(len(toks))) AS pos, unnest(toks) AS token
  FROM arr)"""


def _draw(*parts: str) -> str:
    return f"md5(concat_ws('|', '{EDA_SEED}', {', '.join(parts)}))"


def _u32(h: str) -> str:
    return f"('0x' || substr({h}, 1, 8))::BIGINT"


_DELETE = f"""d AS (
  SELECT *, {_draw("'delete'", 'row_key', 'pos')} AS h FROM tok),
kept AS (
  SELECT row_key, string_agg(token, ' ' ORDER BY pos)
           FILTER ({_u32('h')} / 4294967296.0::DOUBLE >= 0.1::DOUBLE) AS kept,
         arg_max(token, h) AS last_one
  FROM d GROUP BY row_key)"""
_SWAP = f"""s AS (
  SELECT *, row_number() OVER (
      PARTITION BY row_key ORDER BY {_draw("'swap'", 'row_key', 'pos')}, pos) - 1 AS r
  FROM tok),
moved AS (
  SELECT *, CASE WHEN l >= 2 AND r < 2 * k
    THEN sum(pos) OVER (PARTITION BY row_key, r // 2) - pos ELSE pos END AS new_pos
  FROM s),
swapped AS (
  SELECT row_key, string_agg(token, ' ' ORDER BY new_pos) AS text FROM moved GROUP BY row_key)"""


def _rebuilt(source: str, made: str, text: str, kind: str) -> str:
    return f"""SELECT b.row_key || '#{kind}' AS row_key, b.ID, {text} AS text, b.target,
  '{kind}' AS aug_kind
FROM {source} b LEFT JOIN {made} m ON m.row_key = b.row_key"""


def _delete_rows(source: str) -> str:
    text = "CASE WHEN b.text IS NOT NULL THEN coalesce(m.kept, m.last_one, '') END"
    return _rebuilt(source, "kept", text, "delete")


def _swap_rows(source: str) -> str:
    text = "CASE WHEN b.text IS NOT NULL THEN coalesce(m.text, '') END"
    return _rebuilt(source, "swapped", text, "swap")


ORACLES["eda_delete"] = f"WITH {DOCS}, {_exploded('docs')}, {_DELETE} {_delete_rows('docs')}"
ORACLES["eda_swap"] = f"WITH {DOCS}, {_exploded('docs')}, {_SWAP} {_swap_rows('docs')}"


def _vocabulary(source: str) -> str:
    return f"""vocab AS (
  SELECT DISTINCT unnest({_tokens('text')}) AS token FROM {source})"""


_SYNONYMS = """syn AS (
  SELECT token, i AS n, [token || 's', reverse(token), 're' || token][i + 1] AS synonym
  FROM (SELECT token, unnest(range(length(token) % 3 + 1)) AS i
        FROM vocab WHERE length(token) >= 5)),
sizes AS (SELECT token, count(*) AS size FROM syn GROUP BY token)"""
_PICKED = f"""drawn AS (
  SELECT t.*, syn.synonym, {_draw("'synonym'", 'row_key', 'pos')} AS h
  FROM tok t LEFT JOIN sizes ON sizes.token = t.token
  LEFT JOIN syn ON syn.token = t.token
    AND syn.n = ({_u32(_draw("'pick'", 'row_key', 'pos'))} * sizes.size) // 4294967296),
picked AS (
  SELECT *, CASE WHEN synonym IS NOT NULL THEN row_number() OVER (
    PARTITION BY row_key, synonym IS NULL ORDER BY h, pos) END AS rank
  FROM drawn),
replaced AS (
  SELECT row_key, string_agg(CASE WHEN rank <= k THEN synonym ELSE token END, ' ' ORDER BY pos) AS text
  FROM picked GROUP BY row_key),
merged AS (
  SELECT row_key, pos AS place, 1 AS late, 0 AS rank, token FROM picked
  UNION ALL
  SELECT row_key, ({_u32(_draw("'place'", 'row_key', 'pos'))} * l) // 4294967296, 0, rank, synonym
  FROM picked WHERE rank <= k),
inserted AS (
  SELECT row_key, string_agg(token, ' ' ORDER BY place, late, rank) AS text
  FROM merged GROUP BY row_key)"""
_TURN_TEXT = "CASE WHEN b.text IS NOT NULL THEN coalesce(m.text, '') END"
_TURN_SYN = f"WITH {TURNS}, {_vocabulary('turns')}, {_exploded('turns')}, {_SYNONYMS}, {_PICKED}"
_SYN_ROWS = _rebuilt("turns", "replaced", _TURN_TEXT, "synonym")
_INS_ROWS = _rebuilt("turns", "inserted", _TURN_TEXT, "insert")
_ORIG_ROWS = """SELECT row_key || '#original' AS row_key, ID, text, target,
  'original' AS aug_kind FROM turns"""
ORACLES["eda_synonym"] = f"{_TURN_SYN} {_SYN_ROWS}"
ORACLES["eda_insert"] = f"{_TURN_SYN} {_INS_ROWS}"
_four = " UNION ALL ".join(
    [_ORIG_ROWS, _SYN_ROWS, _swap_rows("turns"), _delete_rows("turns")]
)
ORACLES["eda_notebook"] = f"{_TURN_SYN}, {_DELETE}, {_SWAP} {_four}"
ORACLES["eda_all"] = f"{_TURN_SYN}, {_DELETE}, {_SWAP} {_four} UNION ALL {_INS_ROWS}"

# whitespace and token runs alternate; both are kept, so joining is lossless
_RUNS = f"""runs AS (
  SELECT row_key, ID, target, unnest(range(len(r))) AS pos, unnest(r) AS run
  FROM (SELECT *, regexp_extract_all(text, '[{WS}]+|[^{WS}]+') AS r FROM turns))"""
ORACLES["correct_tokens"] = f"""WITH {TURNS}, {_vocabulary('turns')}, {_RUNS},
fixed AS (
  SELECT row_key, string_agg(coalesce(c.correction, run), '' ORDER BY pos) AS text
  FROM runs LEFT JOIN (
    SELECT token, translate(token, 'aeiou', 'eioua') AS correction
    FROM vocab WHERE length(token) >= 7) c ON c.token = runs.run
  GROUP BY row_key)
{_rebuilt("turns", "fixed", _TURN_TEXT, "corrected")}"""


def _pivot(source: str, keep: bool) -> str:
    wanted = "true" if keep else "m.text IS NOT NULL"
    text = "coalesce(m.text, b.text)" if keep else "m.text"
    return f"""langs(lang, lim) AS (VALUES ('en', 20), ('zh-CN', 1000), ('de', 16)),
pairs AS (
  SELECT lang, token, translate(token, 'aeiou', 'uaeio') AS home
  FROM vocab, langs WHERE length(token) < lim),
rewritten AS (
  SELECT t.row_key, langs.lang,
         CASE WHEN count(*) = count(p.home) THEN string_agg(p.home, ' ' ORDER BY pos) END AS text
  FROM tok t CROSS JOIN langs
  LEFT JOIN pairs p ON p.lang = langs.lang AND p.token = t.token
  GROUP BY ALL),
pivoted AS (
  SELECT b.row_key || '#pivot_' || langs.lang AS row_key, b.ID, {text} AS text, b.target,
         'pivot_' || langs.lang AS aug_kind
  FROM {source} b CROSS JOIN langs
  LEFT JOIN rewritten m ON m.row_key = b.row_key AND m.lang = langs.lang
  WHERE {wanted})"""


_TURN_VOCAB = f"WITH {TURNS}, {_vocabulary('turns')}, {_exploded('turns')}"
ORACLES["pivot_rewrite_keep"] = (
    f"{_TURN_VOCAB}, {_pivot('turns', True)} SELECT * FROM pivoted"
)
ORACLES["pivot_rewrite_drop"] = (
    f"{_TURN_VOCAB}, {_pivot('turns', False)} SELECT * FROM pivoted"
)
_SPELLING = f"""counts AS (
  SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('lower(text)')}) AS token FROM turns) GROUP BY token),
words AS MATERIALIZED (SELECT * FROM counts WHERE regexp_matches(token, '^[a-z]+$')),
pairs AS (
  SELECT u.token, k.token AS correction, k.n, levenshtein(u.token, k.token) AS distance
  FROM words u JOIN words k ON u.n < 3 AND k.n >= 3 AND abs(length(u.token) - length(k.token)) <= 2),
corrections AS (
  SELECT token, correction, distance::INT AS distance FROM pairs WHERE distance <= 2
  QUALIFY row_number() OVER (PARTITION BY token ORDER BY distance, n DESC, correction) = 1)"""
ORACLES["spelling_corrections"] = f"WITH {TURNS}, {_SPELLING} SELECT * FROM corrections"
ORACLES["correct_unknown_tokens"] = f"""WITH {TURNS}, {_SPELLING}, {_RUNS},
fixed AS (
  SELECT row_key, string_agg(coalesce(c.correction, run), '' ORDER BY pos) AS text
  FROM runs LEFT JOIN corrections c ON c.token = runs.run GROUP BY row_key)
{_rebuilt("turns", "fixed", _TURN_TEXT, "corrected")}"""


def _phrases(keep: bool) -> str:
    wanted = "true" if keep else "m.text IS NOT NULL"
    text = "coalesce(m.text, b.text)" if keep else "m.text"
    return f"""WITH RECURSIVE {TURNS}, {_vocabulary('turns')},
langs(lang, lim) AS (VALUES ('en', 20), ('zh-CN', 1000), ('de', 16)),
arr AS MATERIALIZED (SELECT row_key, {_tokens('text')} AS toks FROM turns),
longer AS (
  SELECT DISTINCT n, array_to_string(toks[i:i + n - 1], ' ') AS src
  FROM (SELECT n, toks, unnest(range(1, len(toks) - n + 2)) AS i FROM arr, (VALUES (2), (3)) AS ns(n))),
phr AS MATERIALIZED (
  SELECT lang, 1 AS n, token AS src, translate(token, 'aeiou', 'uaeio') AS home
  FROM vocab, langs WHERE length(token) < lim
  UNION ALL SELECT lang, n, src, '<' || translate(src, 'aeiou', 'uaeio') || '>'
  FROM longer, langs WHERE length(src) % (n + 1) = 0),
walk AS (
  SELECT row_key, lang, 0::BIGINT AS pos, toks, '' AS text FROM arr, langs
  UNION ALL
  SELECT row_key, lang, pos + n, toks, text || ' ' || home FROM (
    SELECT w.row_key, w.lang, w.pos, w.toks, w.text, p.n, p.home,
      row_number() OVER (PARTITION BY w.row_key, w.lang ORDER BY p.n DESC) AS best
    FROM (SELECT *, array_to_string(toks[pos + 1:pos + k], ' ') AS here
          FROM walk, (VALUES (1), (2), (3)) AS ks(k) WHERE pos + k <= len(toks)) w
    JOIN phr p ON p.lang = w.lang AND p.n = w.k AND p.src = w.here)
  WHERE best = 1)
SELECT b.row_key || '#pivot_' || langs.lang AS row_key, b.ID, {text} AS text, b.target,
  'pivot_' || langs.lang AS aug_kind
FROM turns b CROSS JOIN langs
LEFT JOIN (SELECT row_key, lang, substr(text, 2) AS text FROM walk WHERE pos = len(toks)) m
  ON m.row_key = b.row_key AND m.lang = langs.lang
WHERE {wanted}"""


ORACLES["phrase_rewrite_keep"] = _phrases(True)
ORACLES["phrase_rewrite_drop_joined"] = _phrases(False)
ORACLES["score_batches"] = f"""WITH {DOCS}
SELECT row_key, replace(text, 'e', '') AS text FROM docs"""
ORACLES["score_batches_in_order"] = f"""WITH {DOCS}
SELECT row_key, list_reduce(
  list_prepend(7::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)),
  lambda state, c: (state * 31 + c) % 1009)::VARCHAR AS state
FROM docs"""
ORACLES["accumulator_counts"] = """SELECT aug_kind, sum(n)::BIGINT AS n_rows FROM (
  SELECT count(*) AS n FROM conversations) CROSS JOIN (VALUES
  ('original'), ('original'), ('synonym'), ('insert'), ('swap'), ('delete'),
  ('pivot_en'), ('pivot_zh-CN'), ('pivot_de'), ('plain'), ('lower'), ('spaced')) AS k(aug_kind)
GROUP BY aug_kind"""

# --- null, empty, blank and ellipsis texts --------------------------------------------

_ODD = f"""docs AS (
  WITH {DOCS}, kinds(kind) AS (VALUES ('null'), ('empty'), ('blank'), ('dots'), ('ellipsis'))
  SELECT row_key, ID, text, target FROM docs
  UNION ALL
  SELECT row_key || '#' || kind, ID, CASE kind WHEN 'empty' THEN '' WHEN 'blank' THEN ' ' || chr(9) || '\u3000' || chr(10)
    WHEN 'dots' THEN '.....' || text || ' ... …' WHEN 'ellipsis' THEN replace(text, '.', '...') END, target
  FROM docs, kinds WHERE doc_id % 10 = 0)"""
_ODD_HARD = f"WITH {_ODD}, {_hard(LATIN + WS)}"
_ODD_SOFT = f"WITH {_ODD}, {_soft(_latin_noise)}"
ORACLES["noise_ratios_of_odd_texts"] = f"""SELECT row_key, hard, soft
FROM ({_ODD_HARD} SELECT row_key, noise_ratio AS hard FROM measured)
JOIN ({_ODD_SOFT} SELECT row_key, noise_ratio AS soft FROM measured) USING (row_key)"""
_odd_sides = {
    "hard noisy": (_ODD_HARD, "noise_ratio > 0"),
    "hard clean": (_ODD_HARD, "noise_ratio = 0"),
    "soft noisy": (_ODD_SOFT, "noise_ratio > 0.1 AND noise_ratio <= 0.36"),
    "soft clean": (_ODD_SOFT, "noise_ratio <= 0.11"),
}
ORACLES["isolation_of_odd_texts"] = " UNION ALL ".join(
    f"SELECT * FROM ({source} SELECT row_key, text, '{side}' AS side FROM measured WHERE {rule})"
    for side, (source, rule) in _odd_sides.items()
)
ORACLES["noise_filter_of_odd_texts"] = _variants(_ODD, {"filtered": _filtered(_latin_keep)})

# --- prompts and generated text ------------------------------------------------

ORACLES["recovery_prompts"] = f"""WITH {DOCS}
SELECT row_key, {_q(RECOVERY_INSTRUCTION)} || 'Input:' || chr(10) || 'sentence: '
  || coalesce(text, '') || chr(10) || '{ANSWER_MARKER}' || chr(10) AS prompt
FROM docs"""


def _recovery(on_missing: str) -> str:
    # by construction the answer is the text without quotes, for en and fr
    found = """CASE WHEN lang IN ('en', 'fr') AND replace(text, '"', '') <> ''
      THEN replace(text, '"', '') WHEN lang = 'fr' THEN 'first' END"""
    text = f"coalesce({found}, text)" if on_missing == "keep" else found
    where = f"WHERE {found} IS NOT NULL" if on_missing == "drop" else ""
    return f"""WITH {DOCS}
SELECT row_key || '#recovered' AS row_key, ID, {text} AS text, target,
  'recovered' AS aug_kind
FROM docs {where}"""


for _mode in ("null", "keep", "drop"):
    ORACLES[f"apply_recovery_{_mode}"] = _recovery(_mode)

_UNQUOTED = r"""regexp_replace({}, '["“”‘’«»„\\,]', '', 'g')"""
ORACLES["quote_strip_filter"] = f"""WITH {DOCS},
cleaned AS (SELECT ID, {_UNQUOTED.format('text')} AS text, target FROM docs)
SELECT * FROM cleaned
WHERE NOT coalesce(contains(text, 'http') OR contains(text, '###'), false)"""


def _hash(op: str, key: str = "row_key") -> str:
    return f"md5(concat_ws('|', '{SPLIT_SEED}', '{op}', {key}))"


ORACLES["sequential_ids"] = f"""WITH {DOCS}
SELECT doc_id, printf('{ID_FORMAT}', row_number() OVER (
  ORDER BY {_hash('id')}, row_key)) AS ID FROM docs"""
_SHOTS = f"""shots AS (
  SELECT row_key, target, text, row_number() OVER (
    PARTITION BY target ORDER BY {_hash('shots')}, row_key)::INTEGER AS rank
  FROM docs QUALIFY rank <= 10)"""
ORACLES["few_shot_sample"] = (
    f"WITH {DOCS}, {_SHOTS} SELECT row_key, target, rank, text FROM shots"
)
ORACLES["few_shot_prompts"] = f"""WITH {DOCS}, {_SHOTS}
SELECT target, {_q(FEW_SHOT_INSTRUCTION)}
  || string_agg('- ' || text || chr(10), '' ORDER BY rank)
  || chr(10) || '{LIST_MARKER}' || chr(10) AS prompt
FROM shots GROUP BY target"""

_GENERATED = rf"""generated AS (
  SELECT row_key, target,
    'prompt' || chr(10) || '{LIST_MARKER}' || chr(10) || '1. example' || chr(10) || '---'
    || chr(10) || '{LIST_MARKER}' || chr(10)
    || array_to_string(list_transform(string_split(text, '. '), lambda s, i:
         i || '. ' || CASE (i - 1) % 3 WHEN 1 THEN '"' || s || '",'
                           WHEN 2 THEN '[''' || s || ''']' ELSE s END), chr(10))
    || chr(10) || 'END' || chr(10) || '99. late' AS output
  FROM docs),
lines AS (
  SELECT row_key, target, unnest(range(len(ls))) AS line_no, unnest(ls) AS line
  FROM (SELECT *, string_split(
          trim(string_split(output, '{LIST_MARKER}')[-1], {WS_LIT}), chr(10)) AS ls
        FROM generated)),
flagged AS (
  SELECT *, regexp_matches(line, '^[{WS}]*\p{{Nd}}+\.') AS numbered FROM lines),
numbered_so_far AS (
  SELECT *, bool_and(numbered) OVER (PARTITION BY row_key ORDER BY line_no) AS ok FROM flagged),
cut AS (
  SELECT row_key, target, line_no, trim(trim(
      regexp_replace(line, '^[{WS}]*\p{{Nd}}+\.[{WS}]*', ''), {WS_LIT}), '[]"'',') AS text
  FROM numbered_so_far WHERE ok),
titles AS (
  SELECT row_key, target, (row_number() OVER (
    PARTITION BY row_key ORDER BY line_no) - 1)::INTEGER AS title_no, text
  FROM cut WHERE text <> '')"""
ORACLES["parse_generations"] = f"""WITH {DOCS}, {_GENERATED}
SELECT row_key, target, title_no, text FROM titles"""
# the stream also removes quotes and copied phrases
ORACLES["stream_parse_generations"] = f"""WITH {DOCS}, {_GENERATED}
SELECT row_key, target, title_no, {_UNQUOTED.format('text')} AS text
FROM titles WHERE NOT contains({_UNQUOTED.format('text')}, 'IT 기업들')"""
_ROUNDS = f"""WITH {DOCS}, {_GENERATED},
cleaned AS (
  SELECT row_key::BIGINT % 3 AS round, row_key || '#' || title_no AS row_key, target,
    {_UNQUOTED.format('text')} AS text
  FROM titles)
SELECT printf('{ID_FORMAT}', row_number() OVER (ORDER BY round, {_hash('id')}, row_key)) AS ID, text, target
FROM cleaned WHERE NOT contains(text, 'IT 기업들')"""
ORACLES["numbered_rounds"] = _ROUNDS
ORACLES["stream_numbered_titles"] = _ROUNDS
_SYNTHETIC = f"""cleaned AS (
  SELECT row_key || '#' || title_no AS row_key, target, {_UNQUOTED.format('text')} AS text
  FROM titles),
synthetic AS (
  SELECT printf('{ID_FORMAT}', row_number() OVER (ORDER BY {_hash('id')}, row_key)) AS ID,
         text, target
  FROM cleaned WHERE NOT contains(text, 'http'))"""
ORACLES["synthetic_final"] = (
    f"WITH {DOCS}, {_GENERATED}, {_SYNTHETIC} SELECT * FROM synthetic"
)
ORACLES["synthetic_merge"] = f"""WITH {DOCS}, {_GENERATED}, {_SYNTHETIC},
base AS (SELECT printf('{ID_FORMAT}', doc_id) AS ID, text, target FROM docs)
SELECT * FROM base UNION ALL
SELECT CASE WHEN ID IN (SELECT ID FROM base) THEN 'syn-' || ID ELSE ID END, text, target
FROM synthetic"""

# --- splits and orders -----------------------------------------------------------


def _side(valid: str) -> str:
    return f"CASE WHEN {valid} THEN 'valid' ELSE 'train' END AS side"


_below = f"{_u32(_hash('split', '{}'))} / 4294967296.0::DOUBLE < 0.2::DOUBLE"
ORACLES["split_hash"] = (
    f"WITH {DOCS} SELECT row_key, {_side(_below.format('row_key'))} FROM docs"
)
ORACLES["split_exact"] = f"""WITH {DOCS}
SELECT row_key, {_side(f'''row_number() OVER (ORDER BY {_hash('split')}, row_key)
  <= ceil((SELECT count(*) FROM docs) * 0.2::DOUBLE)''')} FROM docs"""
ORACLES["split_group"] = f"""WITH {DOCS}
SELECT row_key || '#' || kind AS row_key, {_side(_below.format('ID'))}
FROM docs CROSS JOIN (VALUES ('original'), ('plain'), ('lower'), ('spaced')) AS k(kind)"""
ORACLES["shuffle_order"] = f"""WITH {DOCS}
SELECT doc_id, row_number() OVER (ORDER BY {_hash('shuffle')}, row_key) AS position FROM docs"""
ORACLES["shuffled_documents"] = f"WITH {DOCS} SELECT ID, text, target FROM docs"

# --- scores, relabelling, metrics ---------------------------------------------------

_FOLDS = f"""rows_ AS (
  SELECT vec_id::VARCHAR AS row_key, label AS target,
         list_transform(embedding, lambda x: x::DOUBLE) AS v,
         {_u32("md5(concat_ws('|', 'fold', vec_id))")} / 4294967296.0::DOUBLE < 0.5 AS fold
  FROM embeddings),
dims AS (
  SELECT NOT fold AS fold, target AS class, d, avg(v[d]) AS m
  FROM rows_, range(1, 65) AS r(d) GROUP BY 1, 2, 3),
cents AS (SELECT fold, class, list(m ORDER BY d) AS c FROM dims GROUP BY fold, class)"""
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_SCORES = f"""WITH {_FOLDS},
logits AS (
  SELECT row_key, target, class, {_DOT.format(a='v', b='c')} * 10.0::DOUBLE AS x
  FROM rows_ JOIN cents USING (fold)),
exps AS (
  SELECT *, exp(x - max(x) OVER (PARTITION BY row_key)) AS e FROM logits),
scores AS (
  SELECT row_key, target, class,
         round(e / sum(e) OVER (PARTITION BY row_key) * 1e6::DOUBLE)::BIGINT AS p
  FROM exps)"""
ORACLES["class_centroid_scores"] = f"""{_SCORES}
SELECT row_key, target, class, p / 1e6::DOUBLE AS prob FROM scores"""


def _cosine(first: int) -> str:
    a, b = f"v[{first}:{first + 15}]", f"c[{first}:{first + 15}]"
    return (
        f"round({_DOT.format(a=a, b=b)} / (sqrt({_DOT.format(a=a, b=a)}) "
        f"* sqrt({_DOT.format(a=b, b=b)})) * 1e6::DOUBLE)"
    )


_total = " + ".join(_cosine(f) for f in (1, 17, 33, 49))
_ENSEMBLE = f"""WITH {_FOLDS},
sums AS (
  SELECT row_key, class, ({_total})::BIGINT AS s FROM rows_ JOIN cents USING (fold))
SELECT row_key, class AS target FROM sums
QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY s DESC, class) = 1"""
ORACLES["ensemble_relabel_by_model"] = _ENSEMBLE
ORACLES["ensemble_relabel"] = _ENSEMBLE

_PREDICTIONS = """predicted AS (
  SELECT row_key, target, class AS prediction FROM scores
  QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY p DESC, class) = 1)"""
_PREDICTED = f"{_SCORES}, {_PREDICTIONS}"
_ISSUES = f"""{_PREDICTIONS},
thresholds AS (
  SELECT class, sum(p)::DOUBLE / count(*) AS t FROM scores WHERE class = target GROUP BY class),
guesses AS (
  SELECT row_key, target, class AS guess FROM scores JOIN thresholds USING (class)
  WHERE p >= t
  QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY p DESC, class) = 1),
cells AS (SELECT target, guess, count(*) AS n FROM guesses GROUP BY 1, 2),
joint_ AS (
  SELECT target, guess, n,
    (2 * n * (SELECT count(*) FROM predicted r WHERE r.target = cells.target)
      + sum(n) OVER (PARTITION BY target)) // (2 * sum(n) OVER (PARTITION BY target)) AS calibrated
  FROM cells),
margins AS (
  SELECT s.row_key, s.target, s.class AS j, g.p - s.p AS shortfall
  FROM scores s JOIN scores g ON g.row_key = s.row_key AND g.class = g.target
  WHERE s.class <> s.target),
flagged AS (
  SELECT m.row_key FROM margins m JOIN joint_ c ON c.target = m.target AND c.guess = m.j
  QUALIFY row_number() OVER (PARTITION BY m.target, m.j
    ORDER BY shortfall, md5(concat_ws('|', '{RANK_SEED}', m.row_key)), m.row_key) <= c.calibrated),
issues AS (
  SELECT p.row_key, p.target, p.prediction AS suggested, s.p AS confidence
  FROM predicted p JOIN scores s ON s.row_key = p.row_key AND s.class = p.target
  WHERE p.prediction <> p.target AND p.row_key IN (SELECT row_key FROM flagged))"""
_LEARN = f"{_SCORES}, {_ISSUES}"
ORACLES["label_thresholds"] = f"""{_LEARN}
SELECT class AS target, t / 1e6::DOUBLE AS threshold FROM thresholds"""
ORACLES["confident_joint"] = f"""{_LEARN}
SELECT target, guess, n, calibrated::BIGINT AS calibrated FROM joint_"""
_RANKED_ISSUES = f"""SELECT row_key, target, suggested, confidence / 1e6::DOUBLE AS self_confidence,
  row_number() OVER (ORDER BY confidence,
    md5(concat_ws('|', '{RANK_SEED}', row_key)), row_key) AS rank
FROM issues"""
ORACLES["label_issues"] = f"{_LEARN} {_RANKED_ISSUES}"
_CORRECTED = f"""{_LEARN}
SELECT p.row_key, coalesce(i.suggested, p.target) AS target
FROM predicted p LEFT JOIN issues i USING (row_key)"""
ORACLES["corrected_labels"] = _CORRECTED
ORACLES["corrected_labels_by_key"] = _CORRECTED
ORACLES["issue_rows"] = f"{_LEARN} SELECT row_key, target FROM issues"
_F1 = f"""{_PREDICTED},
classes AS (SELECT target AS class FROM predicted UNION SELECT prediction FROM predicted),
f1s AS (
  SELECT class, (SELECT 2.0::DOUBLE * count(*) FILTER (target = class AND prediction = class)
      / (count(*) FILTER (target = class) + count(*) FILTER (prediction = class))
    FROM predicted) AS f1
  FROM classes)"""
ORACLES["class_f1"] = f"{_F1} SELECT class, round(f1, 9) AS f1 FROM f1s"
ORACLES["macro_f1"] = f"{_F1} SELECT round(avg(f1), 9) AS macro_f1 FROM f1s"

for _name in ("eda_all", "correct_tokens"):
    ORACLES[f"{_name}_joined"] = ORACLES[_name]
ORACLES["pivot_rewrite_joined"] = ORACLES["pivot_rewrite_keep"]

# --- end to end: row counts -----------------------------------------------------------

_corpus_as_docs = f"{LABELLED}, docs AS (SELECT * FROM corpus)"
_HARD_SIDES = f"""WITH {_corpus_as_docs}, {_hard(LATIN + WS)},
sides AS (
  SELECT CASE WHEN noise_ratio > 0 THEN 'noisy' ELSE 'clean' END AS side, row_key, ID, text, target
  FROM measured WHERE noise_ratio IS NOT NULL)"""


def _counted(side: str, kinds: list[str]) -> str:
    values = ", ".join(f"('{k}')" for k in kinds)
    return f"""SELECT side, aug_kind, count(*) AS n_rows
FROM sides CROSS JOIN (VALUES {values}) AS k(aug_kind) WHERE side = '{side}' GROUP BY ALL"""


_NAIVE_KINDS = ["original", "plain", "lower", "spaced"]
_EDA_KINDS = ["original", "synonym", "insert", "swap", "delete"]
ORACLES["hard_flow_counts"] = f"""{_HARD_SIDES}
{_counted('noisy', _NAIVE_KINDS)} UNION ALL
{_counted('clean', _EDA_KINDS + ['pivot_en', 'pivot_zh-CN', 'pivot_de'])}"""
ORACLES["soft_flow_counts"] = f"""WITH {_corpus_as_docs}, {_soft(_latin_noise)},
sides AS (
  SELECT 'noisy' AS side FROM measured WHERE noise_ratio > 0.1 AND noise_ratio <= 0.36
  UNION ALL SELECT 'clean' FROM measured WHERE noise_ratio <= 0.11)
{_counted('noisy', ['recovered', 'corrected', 'pivot_en', *_EDA_KINDS])} UNION ALL
{_counted('clean', ['filtered', 'recovered', 'corrected', 'pivot_en', *_EDA_KINDS])}"""
ORACLES["notebook_flow_counts"] = f"""{_HARD_SIDES},
clean AS (SELECT row_key, ID, text, target FROM sides WHERE side = 'clean'),
{_vocabulary('corpus')}, {_exploded('clean')}, {_pivot('clean', False)}
{_counted('noisy', _NAIVE_KINDS)} UNION ALL
{_counted('clean', ['original', 'synonym', 'swap', 'delete'])} UNION ALL
SELECT 'clean', aug_kind, count(*) FROM pivoted GROUP BY aug_kind"""

# --- end to end: texts --------------------------------------------------------------

_BOTH_SIDES = f"""{_HARD_SIDES},
noisy AS (SELECT row_key || '#noisy' AS row_key, ID, text, target FROM sides WHERE side = 'noisy'),
clean AS (SELECT row_key || '#clean' AS row_key, ID, text, target FROM sides WHERE side = 'clean'),
{_vocabulary('corpus')}, {_exploded('clean')}, {_SYNONYMS}, {_PICKED}, {_DELETE}, {_SWAP}"""


def _flow_rows(insert: bool, keep: bool) -> str:
    noisy = " UNION ALL ".join(
        f"SELECT row_key || '#{kind}' AS row_key, ID, '{kind}' AS aug_kind, {text} AS text, "
        "target::VARCHAR AS target FROM noisy"
        for kind, text in LATIN_NAIVE.items()
    )
    made = [
        "SELECT row_key || '#original' AS row_key, ID, text, target, 'original' AS aug_kind FROM clean",
        _rebuilt("clean", "replaced", _TURN_TEXT, "synonym"),
        _swap_rows("clean"),
        _delete_rows("clean"),
        "SELECT row_key, ID, text, target, aug_kind FROM pivoted",
    ]
    if insert:
        made.append(_rebuilt("clean", "inserted", _TURN_TEXT, "insert"))
    return f"""{_BOTH_SIDES}, {_pivot('clean', keep)},
made AS ({" UNION ALL ".join(made)})
{noisy} UNION ALL SELECT row_key, ID, aug_kind, text, NULL FROM made"""


ORACLES["hard_flow_rows"] = _flow_rows(insert=True, keep=True)
ORACLES["notebook_flow_rows"] = _flow_rows(insert=False, keep=False)

_SOFT_SIDES = f"""WITH {_corpus_as_docs}, {_soft(_latin_noise)},
clean AS (
  SELECT row_key || '#clean' AS row_key, ID, text, target FROM measured WHERE noise_ratio <= 0.11),
base AS (
  SELECT row_key || '#noisy#filtered' AS row_key, ID, {_filtered(_latin_keep)} AS text, target
  FROM measured WHERE noise_ratio > 0.1 AND noise_ratio <= 0.36
  UNION ALL SELECT * FROM clean),
{_vocabulary('corpus')}, {_exploded('base')}, {_SYNONYMS}, {_PICKED}, {_DELETE}, {_SWAP}"""
ORACLES["soft_flow_rows"] = f"""{_SOFT_SIDES}, {_pivot('base', True)},
{_RUNS.replace("FROM turns", "FROM base")},
fixed AS (
  SELECT row_key, string_agg(coalesce(c.correction, run), '' ORDER BY pos) AS text
  FROM runs LEFT JOIN (
    SELECT token, translate(token, 'aeiou', 'eioua') AS correction
    FROM vocab WHERE length(token) >= 7) c ON c.token = runs.run
  GROUP BY row_key),
made AS (
  SELECT row_key || '#filtered' AS row_key, ID, {_filtered(_latin_keep)} AS text, target, 'filtered' AS aug_kind
  FROM clean
  UNION ALL SELECT row_key || '#recovered', ID, row_key, target, 'recovered' FROM base
  UNION ALL SELECT row_key || '#original', ID, text, target, 'original' FROM base
  UNION ALL {_rebuilt("base", "fixed", _TURN_TEXT, "corrected")}
  UNION ALL {_rebuilt("base", "replaced", _TURN_TEXT, "synonym")}
  UNION ALL {_rebuilt("base", "inserted", _TURN_TEXT, "insert")}
  UNION ALL {_swap_rows("base")}
  UNION ALL {_delete_rows("base")}
  UNION ALL SELECT row_key, ID, text, target, aug_kind FROM pivoted WHERE aug_kind = 'pivot_en')
SELECT row_key, ID, aug_kind, text, CASE WHEN contains(row_key, '#noisy#') THEN target::VARCHAR END AS target
FROM made"""

# --- trained models: each row gets a class --------------------------------------------

ORACLES["mllib_predict"] = f"""WITH {LABELLED}
SELECT row_key, true AS has_class FROM corpus WHERE target IS NULL"""
for _name in ("mllib_relabel_all", "mllib_ensemble"):
    ORACLES[_name] = f"WITH {LABELLED} SELECT row_key, true AS has_class FROM corpus"

# --- naive Bayes --------------------------------------------------------------------


def _bayes(ngram: int, uses: str) -> str:
    """Tables for a model with ``ngram``, trained on rows of ``uses (part, row_key,
    text, target, learn)`` with ``learn`` and applied to the part's other rows."""
    gram = " || ' ' || ".join(f"t[i + {k}]" for k in range(1, ngram + 1))
    log = "round(ln((coalesce(n, 0) + 1)::DOUBLE / {size}::DOUBLE) * 1e6::DOUBLE)::BIGINT"
    return f"""grams{ngram} AS (
  SELECT *, {_u32("md5(g)")} % 4096 AS f FROM (
    SELECT part, row_key, target, learn, unnest(
      list_transform(range(len(t) - {ngram - 1}), lambda i: {gram})) AS g
    FROM (SELECT *, {_tokens("coalesce(text, '')")} AS t FROM {uses}))),
parts{ngram} AS (SELECT DISTINCT part, class FROM {uses}, range(4) AS r(class)),
sizes{ngram} AS (
  SELECT p.part, class, count(target) AS n_features FROM parts{ngram} p
  LEFT JOIN grams{ngram} g ON g.part = p.part AND learn AND target = class GROUP BY ALL),
priors{ngram} AS (
  SELECT part, class, {log.format(size="(sum(n) OVER (PARTITION BY part) + 4)")} AS prior FROM (
    SELECT p.part, class, count(target) AS n FROM parts{ngram} p
    LEFT JOIN {uses} u ON u.part = p.part AND learn AND target = class GROUP BY ALL)),
counts{ngram} AS (
  SELECT part, target AS class, f, count(*) AS n FROM grams{ngram}
  WHERE learn AND target IS NOT NULL GROUP BY ALL),
logs{ngram} AS (
  SELECT s.part, s.class, f, {log.format(size="(n_features + 4096)")} AS w
  FROM sizes{ngram} s CROSS JOIN (SELECT unnest(range(4096)) AS f)
  LEFT JOIN counts{ngram} USING (part, class, f)),
found{ngram} AS (
  SELECT part, row_key, class, sum(w) AS w FROM grams{ngram} JOIN logs{ngram} USING (part, f)
  WHERE NOT learn GROUP BY ALL),
raw{ngram} AS (
  SELECT part, u.row_key, u.target, class, (prior + coalesce(w, 0)) / 1e6::DOUBLE AS x
  FROM {uses} u JOIN priors{ngram} USING (part) LEFT JOIN found{ngram} USING (part, row_key, class)
  WHERE NOT learn)"""


def _softmax(raw: str) -> str:
    return f"""exps AS (
  SELECT *, exp(x - max(x) OVER (PARTITION BY row_key)) AS e FROM {raw}),
shares AS (SELECT *, e / sum(e) OVER (PARTITION BY row_key) AS share FROM exps),
scores AS (
  SELECT row_key, target, class, round(share * 1e6::DOUBLE)::BIGINT AS p FROM shares),
chosen AS (
  SELECT row_key, target, class AS prediction FROM shares
  QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY share DESC, class) = 1)"""


_SIDES = f"sides AS (SELECT *, {_u32(_hash('split'))} / 4294967296.0::DOUBLE < 0.5::DOUBLE AS valid FROM corpus)"
_HALVES = f"""{_SIDES},
uses AS (
  SELECT part, row_key, text, target, valid = (part = 1) AS learn FROM sides, range(2) AS r(part))"""
_CROSS = f"WITH {LABELLED}, {_HALVES}"
_VALID = f"""WITH {LABELLED},
uses AS (
  SELECT 0 AS part, row_key, text, target, NOT ({_below.format('row_key')}) AS learn
  FROM corpus WHERE target IS NOT NULL)"""


def _f1_of(predicted: str) -> str:
    return f"""(SELECT avg(f1) FROM (
  SELECT 2.0::DOUBLE * count(*) FILTER (side = 0 AND target = prediction) / count(*) AS f1
  FROM (SELECT target AS class, 0 AS side, target, prediction FROM {predicted}
        UNION ALL SELECT prediction, 1, target, prediction FROM {predicted})
  GROUP BY class))"""


ORACLES["bayes_predict"] = f"""WITH {LABELLED},
uses AS (SELECT 0 AS part, row_key, text, target, target IS NOT NULL AS learn FROM corpus),
{_bayes(1, 'uses')}, {_softmax('raw1')}
SELECT row_key, prediction AS target FROM chosen"""
ORACLES["bayes_evaluate"] = f"""{_VALID}, {_bayes(1, 'uses')}, {_softmax('raw1')}
SELECT round({_f1_of('chosen')}, 9) AS macro_f1"""
ORACLES["bayes_relabel_all"] = f"""{_CROSS}, {_bayes(1, 'uses')}, {_softmax('raw1')}
SELECT row_key, prediction AS target FROM chosen"""
ORACLES["bayes_ensemble"] = f"""{_CROSS}, {_bayes(1, 'uses')}, {_bayes(2, 'uses')}
SELECT a.row_key, class AS target FROM raw1 a JOIN raw2 b USING (part, row_key, class)
QUALIFY row_number() OVER (PARTITION BY a.row_key ORDER BY (a.x + b.x) / 2 DESC, class) = 1"""
ORACLES["relabel_run"] = f"""WITH {LABELLED}, {_SIDES},
uses AS (SELECT 0 AS part, row_key, text, target, NOT valid AS learn FROM sides),
{_bayes(1, 'uses')}, {_softmax('raw1')}, {_ISSUES}
SELECT p.row_key AS ID, coalesce(i.suggested, p.target, p.prediction) AS target
FROM predicted p LEFT JOIN issues i USING (row_key)"""
ORACLES["bayes_label_issues"] = f"""{_CROSS}, {_bayes(1, 'uses')}, {_softmax('raw1')},
{_ISSUES}
{_RANKED_ISSUES}"""
_CROSS_FOLDS = f"""WITH {LABELLED},
uses AS (
  SELECT part, row_key, text, target, {_u32(_hash('fold'))} % 5 <> part AS learn
  FROM corpus, range(5) AS r(part) WHERE target IS NOT NULL)"""
for _name, _uses in (("bayes_best_spec", _VALID), ("bayes_cross_validated_spec", _CROSS_FOLDS)):
    ORACLES[_name] = f"""{_uses}, {_bayes(1, 'uses')}, {_bayes(2, 'uses')},
picked AS (
  SELECT ngram, row_key, target, class AS prediction
  FROM (SELECT 1 AS ngram, * FROM raw1 UNION ALL SELECT 2, * FROM raw2)
  QUALIFY row_number() OVER (PARTITION BY ngram, row_key ORDER BY x DESC, class) = 1),
one AS (SELECT * FROM picked WHERE ngram = 1), two AS (SELECT * FROM picked WHERE ngram = 2),
f1s AS (SELECT 1 AS ngram, {_f1_of('one')} AS f1 UNION ALL SELECT 2, {_f1_of('two')}),
best AS (SELECT * FROM f1s ORDER BY f1 DESC, ngram LIMIT 1)
SELECT row_key, prediction AS target, ngram, round(f1, 9) AS macro_f1
FROM picked JOIN best USING (ngram)"""

# --- linear models, trained together ---------------------------------------------------

_SLOPES = """CASE m
      WHEN 0 THEN e / sum(e) OVER (PARTITION BY row_key, m) - y
      WHEN 1 THEN 1 / (1 + exp(-s)) - y
      WHEN 2 THEN (1 - 2 * y) * greatest(0, 1 - (2 * y - 1) * s)
      ELSE s - (2 * y - 1) END"""


# half of the inverse curvature of each loss
_STEP = "[1.0, 2.0, 0.5, 0.5][m + 1]::DOUBLE"


def _linear_step(t: int) -> str:
    """Scores with the weights of step ``t``, and the weights of the next."""
    return f"""sums{t} AS MATERIALIZED (
  SELECT row_key, m, c, sum(w) AS w FROM grams JOIN w{t} USING (f) GROUP BY ALL),
s{t} AS MATERIALIZED (
  SELECT d.*, m, c, (coalesce(b.w, 0) + coalesce(x.w, 0)::DOUBLE / norm) / 1e6::DOUBLE AS s,
    (target IS NOT NULL AND target = c)::INT::DOUBLE AS y
  FROM sized d CROSS JOIN cells LEFT JOIN sums{t} x USING (row_key, m, c)
  LEFT JOIN (SELECT * FROM w{t} WHERE f = 4096) b USING (m, c)),
slopes{t} AS MATERIALIZED (
  SELECT row_key, norm, m, c, {_SLOPES} AS r
  FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY row_key, m)) AS e FROM s{t} WHERE target BETWEEN 0 AND 3)),
g{t} AS MATERIALIZED (
  SELECT m, c, f, sum(floor(r * 1e6::DOUBLE / norm + 0.5::DOUBLE)::BIGINT) AS g
  FROM slopes{t} JOIN grams USING (row_key) GROUP BY ALL
  UNION ALL SELECT m, c, 4096, sum(floor(r * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT) FROM slopes{t} GROUP BY ALL),
w{t + 1} AS MATERIALIZED (
  SELECT m, c, f, floor(coalesce(w, 0) * (1.0::DOUBLE - {_STEP} * {LINEAR.decay}::DOUBLE)
    - g * {_STEP} / (SELECT count(*) FROM sized WHERE target BETWEEN 0 AND 3) + 0.5::DOUBLE)::BIGINT AS w
  FROM g{t} LEFT JOIN w{t} USING (m, c, f))"""


_LINEAR = f"""WITH {LABELLED},
toks AS (SELECT row_key, target, {_tokens("coalesce(text, '')")} AS t FROM corpus),
grams AS MATERIALIZED (SELECT row_key, {_u32("md5(g)")} % 4096 AS f FROM (SELECT row_key, unnest(t) AS g FROM toks)),
sized AS MATERIALIZED (
  SELECT row_key, target, coalesce(norm, 1) AS norm FROM toks LEFT JOIN (
    SELECT row_key, sqrt(sum(n * n)::DOUBLE) AS norm
    FROM (SELECT row_key, f, count(*) AS n FROM grams GROUP BY ALL) GROUP BY row_key) USING (row_key)),
cells AS (SELECT m, c FROM range(4) AS ms(m), range(4) AS cs(c)),
w0 AS (SELECT m, c, 4096 AS f, 0::BIGINT AS w FROM cells),
{", ".join(_linear_step(t) for t in range(LINEAR.iterations + 1))},
scales AS (
  SELECT m, sum(floor(abs(s) * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT)::DOUBLE / (1e6::DOUBLE * count(*)) AS scale
  FROM s{LINEAR.iterations} WHERE target BETWEEN 0 AND 3 GROUP BY m),
scaled AS (SELECT row_key, m, c, s / scale AS x FROM s{LINEAR.iterations} JOIN scales USING (m))"""
for _m, _name in enumerate(LINEAR.losses):
    ORACLES[f"linear_{_name}"] = f"""{_LINEAR}
SELECT row_key, c AS target FROM scaled WHERE m = {_m}
QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY round(x, 9) DESC, c) = 1"""
ORACLES["linear_ensemble"] = f"""{_LINEAR}
SELECT row_key, c AS target FROM (SELECT row_key, c, sum(x) AS x FROM scaled GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY round(x, 9) DESC, c) = 1"""

# --- CSV in and out --------------------------------------------------------------------


def _read(text: str) -> str:
    missing = ", ".join(_q(x) for x in NA_VALUES)
    return f"CASE WHEN {text} NOT IN ({missing}) THEN {text} END AS text"


ORACLES["path_or_frame"] = f"""WITH {DOCS}
SELECT ID, {_read('text')}, target, 0 AS source FROM docs
UNION ALL SELECT ID, text, target, unnest([1, 2]) FROM docs"""
ORACLES["csv_round_trip"] = f"WITH {DOCS} SELECT ID, {_read('text')}, target FROM docs"
ORACLES["csv_many_files"] = f"""WITH {DOCS}
SELECT ID, {_read('text')}, CASE WHEN target % 3 < 2 THEN target::VARCHAR END AS target FROM docs"""
ORACLES["csv_append"] = f"""WITH {DOCS}
SELECT {_read('text')}, target FROM docs UNION ALL SELECT {_read('lower(text)')}, target FROM docs"""
ORACLES["csv_unquoted"] = rf"""WITH {DOCS}
SELECT unnest(regexp_split_to_array(ID || ',' ||
    regexp_replace(coalesce(text, ''), '([\\,"\r\n])', '\\\1', 'g') || ',' || target,
  '\r\n|\r|\n')) AS value
FROM docs"""
