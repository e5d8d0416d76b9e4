"""Whole licence files and notices, however they are wrapped."""

import re
import textwrap

import duckdb

from corpusmith.llm import licences
from corpusmith.llm.queries import ORACLES
from tests.test_queries import rows_of

TEXTS = licences.whole_texts()
APACHE, GPL = licences.KNOWN["Apache-2.0"][1], licences.KNOWN["GPL-3.0"][1]


def wrapped(text, width):
    """The paragraphs of a text, filled anew to a width."""
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in re.split(r"\n\s*\n", text))


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(licences.scan(docs).collect())
    return [(r.licence, r.n_notices, r.notices) for r in rows]


def test_whole_files_have_their_licence(spark):
    names = [n for n, of in TEXTS.items() for _ in of]
    got = scanned(spark, [t for of in TEXTS.values() for t in of])
    assert [g[0] for g in got] == names
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "LGPL-2.1", "LGPL-3.0"} <= set(names)
    assert {"GPL-2.0", "GPL-3.0", "CC0-1.0", "Unlicense", "0BSD", "Zlib", "BSL-1.0"} <= set(names)


def test_wrapping_and_holders_do_not_matter(spark):
    names = ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Zlib"]
    holders = ["Copyright (c) 2019 Jane Doe", "Copyright 2001-2020 A, B and others\nAll rights reserved.", "© Jane Doe", "Copyright Jane Doe"]
    want, texts = [], []
    for name in names:
        for width in (40, 55, 70, 80, 10_000):
            for holder in holders:
                want.append(name)
                title = licences.TITLES[name][0]
                texts.append(f"{title}\n\n{holder}\n\n{wrapped(TEXTS[name][0], width)}\n")
    assert [g[0] for g in scanned(spark, texts)] == want
    # one of these holders' lines begins where a wrapped line of the text does
    assert any(re.search(r"(?m)^copyright notice", t) for t in texts)


def test_wrapped_notices_are_found_in_other_text(spark):
    comment = textwrap.indent(textwrap.fill(APACHE, 60), " * ")
    mpl = licences.HEADERS["MPL-2.0"][0]
    texts = [
        f"Some words.\n\n{textwrap.fill(GPL, 72)}\n\nMore words.",
        f"/*\n * Copyright 2020 Jane Doe\n{comment}\n */\nint main() {{}}",
        f"Some words. {textwrap.fill(GPL, 50)} More words.\nReleased under the MIT License.",
        f"A title\n\n{textwrap.fill(mpl, 60)}\n\nEnd",
        f"A title\n\n{mpl}\n\nEnd",
        # a line of its own counts once, below other text or not
        "Words\nReleased under the MIT License.\nwords",
        f"{APACHE}\n\n{APACHE}",
    ]
    assert scanned(spark, texts) == [
        (None, 1, "GPL-3.0"),
        (None, 1, "Apache-2.0"),
        (None, 2, "GPL-3.0,MIT"),
        (None, 1, "MPL-2.0"),
        (None, 1, "MPL-2.0"),
        (None, 1, "MIT"),
        (None, 2, "Apache-2.0"),
    ]


def test_only_true_copyright_lines_are_left_out(spark):
    lines = [
        "copyright notice and this", "(c) You must retain", "COPYRIGHT HOLDERS BE LIABLE", "Copyright License. Subject to",
        "Copyright (c) 2020 X", "Copyright [yyyy] [name]", "All rights reserved.", "(c) 1999 X", "copyright Jane Doe",
    ]
    docs = spark.createDataFrame([(i, f"a\n{x}\nb") for i, x in enumerate(lines)], "i int, text string")
    got = [r[1] for r in sorted(docs.select("i", licences.canonical(docs["text"])).collect())]
    assert [g == "a b" for g in got] == [False] * 4 + [True] * 5


def test_sql_states_the_same_rule(spark, tmp_path):
    """Whole files, wrapped notices, paragraphs, holders' lines and odd rows."""
    comment = textwrap.indent(textwrap.fill(APACHE, 60), " * ")
    mpl = licences.HEADERS["MPL-2.0"][0]
    texts = [t for of in TEXTS.values() for t in of]
    texts += [wrapped(TEXTS[n][0], w) for n in ("MIT", "ISC", "Unlicense", "GPL-2.0") for w in (45, 80)]
    texts += [f"{licences.TITLES['MIT'][0]}\n\n{h}\n\n{TEXTS['MIT'][0]}" for h in (
        "Copyright (c) 2019 Jane Doe", "© Jane Doe", "Copyright by Jane Doe", "Copyright License Holder", "(c) You must",
        "copyright jane", "All rights reserved.", "Copyright [yyyy] [name]", " * Copyright 2020 X")]
    texts += [
        None, "", "licence", "Released under the MIT License.", f"/*\n * Copyright 2020 Jane Doe\n{comment}\n */\nint x;",
        f"Some words.\n\n{textwrap.fill(GPL, 72)}\n\nMore words. {GPL} {GPL}", f"A title\n\n{textwrap.fill(mpl, 60)}\n\nEnd",
        f"Words! {APACHE}\r\nand\r\n\r\n{APACHE}\r\n", "x\nReleased under the MIT Licence. Licensed under CC BY-NC 4.0.\n",
        f"ends.\x0b{GPL}\x0bwords", "word " * 30_000 + GPL,
    ]
    docs = spark.createDataFrame([(i // 2 if i > 100 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(ORACLES["op8_licences"]).df()
    got = licences.scan(docs).toPandas()
    assert rows_of(got) == rows_of(want[list(got.columns)])
    assert got["licence"].notna().sum() > 90 and (got["n_notices"] > 0).sum() > 8
