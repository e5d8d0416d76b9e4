"""Licence scans by the digests of canonical texts.

A text is made canonical: copyright lines left out, A to Z in lower case,
spellings of one meaning made one, everything but letters and digits turned into
single spaces. Texts of one licence then have one digest, which is joined with a
table of known licences: the whole texts in ``licence_texts``, with and without
title, and notices. Looked up are a document as a whole, and, as notices stand
inside other text, each of its lines, sentences and paragraphs, however wrapped.

All of it is built-in functions: one pass over the texts, and a join of the
digests of candidates. Lines, sentences and paragraphs are candidates if they
have a cue word, which every known notice has; ``known_digests`` checks that.

Null texts count as empty; empty texts match nothing. Repeated rows get equal
results, an empty table an empty one. A document may hold any number of notices;
they are counted before they are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.sources.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed values: spellings that count as one
EQUIVALENTS = {
    "licence": "license",
    "sub-license": "sublicense",
    "non-commercial": "noncommercial",
    "https://": "http://",
    "version ": "v",
    "merchantibility": "merchantability",
    "per cent": "percent",
    "organisation": "organization",
}
CUE = "(?i)licen[sc]e|permission|public domain"
SENTENCE_END = r"([.!?]) +"
# a line that names a year or a holder of rights, not wrapped text that begins with
# "copyright notice" or "(c) You must"
YEAR = r"[\[<{(]?(?:(?:19|20)\d\d|19yy|(?i:year|yyyy))"
NO_HOLDER = (
    "Licen[sc]e|Holder|Owner|Notice|Law|Act|Statement|Right|Interest|Treat|Office|Status|Term|Infring|Protect"
)
HOLDER_LINE = (
    r"(^|\n)[ \t/*#;]*(?:©[^\n]*"
    r"|(?i:copyright)[ \t:]*(?:\([cC]\)|©)[^\n]*"
    rf"|(?i:copyright|\(c\))[ \t:,]+{YEAR}[^\n]*"
    rf"|[Cc]opyright[ \t:]+(?:by[ \t]+)?(?!{NO_HOLDER})[A-Z][a-z][^\n]*"
    r"|(?i:all rights reserved)[.!]?[ \t\r*/]*(?=\n|$))"
)
# empty lines, also of comments, part paragraphs
PARAGRAPH_END = r"\n(?:[ \t\r/*#;]*\n)+"
# a sentence's end inside a paragraph, which may be a line's end
_WRAPPED_END = r"(?<=[.!?])\s[\s/*#;]*"

# fixed values: notices of public licences
KNOWN = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
    ),
}


def _gnu(kind: str, start: str, version: str) -> str:
    return (
        f"This {start} redistribute it and/or modify it under the terms of the GNU {kind} Public License "
        f"as published by the Free Software Foundation, {version}."
    )


# standard headers and notices beside them, of one or more sentences
HEADERS = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this work '
        "except in compliance with the License.",
    ),
    "GPL-2.0": (
        _gnu("General", "program is free software; you can", "either version 2 of the License, or (at your option) any later version"),
        _gnu("General", "program is free software: you can", "either version 2 of the License, or (at your option) any later version"),
        _gnu("General", "program is free software; you can", "version 2"),
        _gnu("General", "program is free software; you can", "version 2 of the License"),
    ),
    "GPL-3.0": (
        _gnu("General", "program is free software; you can", "either version 3 of the License, or (at your option) any later version"),
        _gnu("General", "program is free software: you can", "version 3"),
        _gnu("General", "program is free software: you can", "version 3 of the License"),
    ),
    "LGPL-2.0": (
        _gnu("Library General", "library is free software; you can", "either version 2 of the License, or (at your option) any later version"),
    ),
    "LGPL-2.1": (
        _gnu("Lesser General", "library is free software; you can", "either version 2.1 of the License, or (at your option) any later version"),
    ),
    "LGPL-3.0": (
        _gnu("Lesser General", "library is free software: you can", "either version 3 of the License, or (at your option) any later version"),
        _gnu("Lesser General", "program is free software: you can", "either version 3 of the License, or (at your option) any later version"),
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
        "of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
        "of the MPL was not distributed with this file, You can obtain one at https://www.mozilla.org/MPL/2.0/.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
}

# fixed values: titles that files put before the whole text
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"),
    "CC0-1.0": ("Creative Commons Legal Code",),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
}


def bodies() -> list[tuple[str, str]]:
    """``(licence, text)`` of the files shipped. They are named after the licence; what
    follows ``_`` tells versions apart."""
    files = sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))
    return [(file.stem.split("_")[0], file.read_text(encoding="utf-8")) for file in files]


def whole_texts() -> dict[str, tuple[str, ...]]:
    """Whole texts by licence, each without title and with all titles it may have."""
    out: dict[str, list[str]] = {}
    for name, body in bodies():
        out.setdefault(name, []).extend([body, *(f"{t}\n\n{body}" for t in TITLES.get(name, ()))])
    return {name: tuple(texts) for name, texts in out.items()}


def canonical(text: Column) -> Column:
    out = F.regexp_replace(text, HOLDER_LINE, "$1")
    out = F.translate(out, UPPER, LOWER)
    for spelling, one in EQUIVALENTS.items():
        out = F.replace(out, F.lit(spelling), F.lit(one))
    # letters beyond ASCII count as letters
    out = F.regexp_replace(out, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``(digest, licence)``: one row per digest, by default of all texts shipped."""
    notices = [KNOWN, HEADERS] if known is None else [known]
    texts = [(name, text) for group in notices for name, of in group.items() for text in of]
    for name, text in texts:
        if not re.search(CUE, text):
            raise ValueError(f"a text of {name} has none of the cue words")
    if known is None:
        texts += [(name, text) for name, of in whole_texts().items() for text in of]
    frame = spark.createDataFrame(texts, "licence string, text string")
    return frame.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))


def _wrapped_units(text: Column) -> Column:
    """Sentences that run over a line's end, and paragraphs of several sentences;
    those on one line are among the lines and sentences anyway."""
    paragraphs = F.filter(F.split(text, PARAGRAPH_END), lambda p: p.rlike(CUE))
    of = F.transform(
        paragraphs,
        lambda p: F.struct(F.trim(p).alias("whole"), F.split(F.trim(p), _WRAPPED_END).alias("cut")),
    )
    # lines with words are counted, as a pattern over several lines tries each character
    sentences = F.filter(
        F.flatten(of["cut"]),
        lambda u: u.rlike(CUE) & (F.size(F.filter(F.split(u, "\n"), lambda line: line.rlike(r"\w"))) > 1),
    )
    several = F.filter(of, lambda p: F.size(F.filter(p["cut"], lambda u: u.rlike(r"\w"))) > 1)
    return F.concat(sentences, F.transform(several, lambda p: p["whole"]))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(doc_id, digest, licence, n_notices, notices)``: one row per document.

    ``digest`` and ``licence`` are those of the whole text; ``notices`` the
    licences of its lines, sentences and paragraphs, sorted and joined by commas.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    text = F.coalesce(docs["text"], F.lit(""))
    lines = F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), "\n")
    units = F.concat(F.filter(lines, lambda u: u.rlike(CUE)), _wrapped_units(text))
    digests = F.when(text.rlike(CUE), F.transform(units, digest))
    rows = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row_no"),
            docs["doc_id"].alias("doc_id"),
            digest(text).alias("digest"),
            digests.alias("units"),
        ),
        "licence-digests",
    )
    licences = known.select("digest", "licence")
    # unknown lines that repeat within a document count once on their way
    units = (
        rows.where("units IS NOT NULL")
        .select("row_no", F.explode("units").alias("digest"))
        .groupBy("row_no", "digest")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(licences, "digest")
    )
    notices = units.groupBy("row_no").agg(
        F.sum("n").alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"),
    )
    return (
        rows.drop("units")
        .join(licences, "digest", "left")
        .join(notices, "row_no", "left")
        .select(
            "doc_id",
            "digest",
            "licence",
            F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
            F.coalesce("notices", F.lit("")).alias("notices"),
        )
    )
