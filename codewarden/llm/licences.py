"""Licence scans by canonical digests, in DataFrame operations only.

A text is brought to a canonical form: lower case, copyright lines out, equivalent spellings alike, everything
but letters and digits a single space. The SHA-256 of a whole canonical text is joined to the
digests of known licence texts. Two whole texts are looked up in each document: the document
itself, and each of its lines, since a notice is a text of its own wherever it stands.

Digests are a fixed 64 characters, whatever the length of a text, and are joined by equality; Spark
broadcasts the known side while it is small, and shuffles beyond. Documents of equal text are so many
equal rows, so no group is gathered anywhere.

Defined results: a null text has no digest and no licence. A text whose canonical form is empty (no
letters or digits, or copyright lines only) has a digest but is no licence. Known texts with the same canonical form
count as one licence, the least id. Repeated rows are repeated in the result.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.support import small_side

# Equivalent spellings, the second of each pair is used. Applied to lower-case words.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("behaviour", "behavior"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("modelling", "modeling"),
    ("organisation", "organization"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("wilful", "willful"),
    ("per cent", "percent"),
    ("v 2 0", "version 2 0"),
    ("v 3", "version 3"),
)

# Short notices and licence texts that are public.
KNOWN = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
        "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
        "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will "
        "the authors be held liable for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as "
        "being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution."
    ),
}

# Title lines that stand over the short texts.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "0BSD"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License", "zlib"),
    "BSD-3-Clause": (
        "BSD 3-Clause License", "The BSD 3-Clause License", "3-Clause BSD License", "The 3-Clause BSD License",
        "BSD License", "The BSD License", "New BSD License", "BSD-3-Clause",
    ),
    "BSD-2-Clause": (
        "BSD 2-Clause License", "The BSD 2-Clause License", "2-Clause BSD License", "The 2-Clause BSD License",
        "BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause",
    ),
    "BSL-1.0": ("Boost Software License",),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
_CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_GNU = {"GPL": "General Public", "LGPL": "Lesser General Public", "AGPL": "Affero General Public", "GFDL": "Free Documentation"}
_GNU_VERSIONS = ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.2", "GFDL-1.3")
# What notices call a licence, beside its SPDX identifier.
NAMES = {
    "Apache-2.0": (
        "Apache License, Version 2.0", "Apache License 2.0", "Apache Software License 2.0", "Apache Software License, Version 2.0",
        "Apache 2.0", "Apache 2.0 License", "Apache 2 License", "Apache License v2.0", "Apache License, Version 2.0 (the \"License\")",
    ),
    "MIT": ("MIT License", "MIT License (MIT)", "MIT/X11 License", "Expat License"),
    "ISC": ("ISC License",),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": (
        "BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License",
    ),
    "BSL-1.0": ("Boost Software License", "Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Unlicense": ("Unlicense",),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "Mozilla Public License, v. 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"),
    "EPL-1.0": ("Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic License, Version 2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0", "CC0 1.0 Universal", "Creative Commons Zero 1.0", "Creative Commons CC0 1.0 Universal License"),
}
for _of in _GNU_VERSIONS:
    _kind, _, _version = _of.partition("-")
    for _number in {_version, _version.removesuffix(".0")}:
        for _long in (f"GNU {_GNU[_kind]} License", f"GNU {_kind}", _kind):
            for _later in ("", " or later"):
                NAMES[_of] = NAMES.get(_of, ()) + tuple(
                    f"{_long}{_mark}{_number}{_later}" for _mark in (", version ", " v", " ")
                )
    NAMES[_of] += tuple(f"{_of}{end}" for end in ("-only", "-or-later", "+"))
for _code, _long in _CC.items():
    for _version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        NAMES[f"CC-{_code}-{_version}"] = (
            f"CC {_code} {_version}",
            f"CC {_code} {_version} License",
            f"Creative Commons {_code} {_version}",
            f"Creative Commons {_long} {_version}",
            f"Creative Commons {_long} {_version} License",
            f"Creative Commons {_long} {_version} International",
            f"Creative Commons {_long} {_version} International License",
            f"Creative Commons {_long} {_version} Unported License",
        )
OPENINGS = (
    "Licensed under", "Released under", "Distributed under", "Published under", "Available under", "Made available under",
    "License:", "Licensed under the terms of",
    *(f"This {thing} is licensed under" for thing in "work project software file code program content document text".split()),
)


def _forms(text: str) -> set[str]:
    """A licence file's text, with and without its title, the appendix behind its terms, and the marks of its list."""
    out = {text}
    out |= {t[: t.index(END) + len(END)] for t in out for END in ("END OF TERMS AND CONDITIONS",) if END in t}
    out |= {t.strip().partition("\n\n")[2] for t in out}
    return {t for t in out if t.strip()}


def public_licences() -> list[tuple[str, str]]:
    """(licence, text) of ``KNOWN``, public licence texts with and without their title lines, and notices."""
    texts = {name: {text} for name, text in KNOWN.items() if not name.endswith("-notice")}
    for file in resources.files(__package__).joinpath("licence_texts").iterdir():
        if file.name.endswith(".txt"):
            name = file.name.removesuffix(".txt").removesuffix(".regents")
            text = file.read_text("utf-8")
            texts.setdefault(name, set()).update({text} if name.startswith("BSD") else _forms(text))
    body = {re.sub(r"\A.*?(?=Redistribution and use)", "", t, flags=re.S) for t in texts["BSD-3-Clause"]}
    third = r"\n3\. Neither.*?permission\.\n"
    for name, found in (("BSD-3-Clause", body), ("BSD-2-Clause", {re.sub(third, "\n", t, flags=re.S) for t in body})):
        marked = found | {re.sub(r"(?m)^(\s*)[123]\.", r"\1*", t) for t in found}
        texts[name] = marked | {f"All rights reserved.\n{t}" for t in marked}
    for name, titles in TITLES.items():
        texts[name] |= {f"{title}\n{text}" for title in titles for text in texts[name]}
    out = {(name, text) for name, found in texts.items() for text in found} | set(KNOWN.items())
    for name, called in NAMES.items():
        out |= {(f"{name}-notice", f"SPDX-License-Identifier: {x}") for x in (name, *(c for c in called if c.startswith(f"{name}")))}
        out |= {
            (f"{name}-notice", f"{opening} {article}{x}.")
            for opening in OPENINGS
            for x in (name, *called)
            for article in (("", "the ", "a ") if x.startswith("Creative") else ("", "the ") if " " in x else ("",))
        }
    return sorted(out)


#: A line that only says whose the text is.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"


def _folded(text: Column) -> Column:
    """Canonical words, with the line breaks still there."""
    out = F.lower(text)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "$1")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " "), F.lit(" "))
    out = F.replace(out, F.lit("\n"), F.lit(" \n "))
    # A blank on either side of every word, so that words in a row are all replaced.
    out = F.replace(out, F.lit(" "), F.lit("  "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(_apart(old)), F.lit(_apart(new)))
    return out


def _apart(words: str) -> str:
    return " " + words.replace(" ", "  ") + " "


def _whole(folded: Column) -> Column:
    return F.trim(F.regexp_replace(folded, r"[ \n]+", " "))


def canonical(text: Column) -> Column:
    """The canonical form of a whole text."""
    return _whole(_folded(text))


def digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def known_licences(
    spark: SparkSession, texts: dict[str, str] | list[tuple[str, str]] | None = None
) -> DataFrame:
    """(digest, licence) of licence texts, given as licence: text or, for several of one licence, as pairs."""
    texts = KNOWN if texts is None else texts
    pairs = list(texts.items()) if isinstance(texts, dict) else texts
    rows = spark.createDataFrame(pairs, "licence string, text string")
    form = canonical(F.col("text"))
    return (
        rows.filter(F.length(form) > 0)
        .groupBy(digest(form).alias("digest"))
        .agg(F.min("licence").alias("licence"))
    )


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, unit, line, digest, licence): a row with unit ``document`` for each document, its
    licence null if its text is no known one, and a row with unit ``line`` for each line that is.

    ``known`` is broadcast if it is seen to be small, as licence texts are; lines are then not shuffled. Lines
    without words are no licence and aren't looked up."""
    folded = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _folded(F.col("text").cast("string")).alias("folded"),
    )
    forms = F.transform(
        F.split(F.col("folded"), "\n"), lambda line, i: F.struct((i + 1).alias("line"), _whole(line).alias("form"))
    )
    lines = F.transform(
        F.filter(forms, lambda x: x["form"] != ""),
        lambda x: F.struct(F.lit("line").alias("unit"), x["line"].alias("line"), digest(x["form"]).alias("digest")),
    )
    whole = F.array(
        F.struct(F.lit("document").alias("unit"), F.lit(0).alias("line"), digest(_whole(F.col("folded"))).alias("digest"))
    )
    units = folded.select("doc_id", F.explode(F.concat(whole, F.coalesce(lines, F.array().cast(_UNITS)))).alias("u"))
    return (
        units.select("doc_id", "u.unit", "u.line", "u.digest")
        .join(small_side(known), "digest", "left")
        .filter("unit = 'document' OR licence IS NOT NULL")
        .select("doc_id", "unit", "line", "digest", "licence")
    )


_UNITS = "array<struct<unit:string,line:int,digest:string>>"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_folded(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '\\1', 'g')"
    out = f"' ' || regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') || ' '"
    out = f"replace(replace({out}, chr(10), ' ' || chr(10) || ' '), ' ', '  ')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{_apart(old)}', '{_apart(new)}')"
    return out


def _sql_digest(folded: str) -> str:
    return f"sha256(trim(regexp_replace({folded}, '[ \\n]+', ' ', 'g')))"


def scan_sql(known: list[tuple[str, str]]) -> str:
    return f"""
WITH known_texts(licence, text) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in known)}),
known AS (
  SELECT {_sql_digest("folded")} AS digest, min(licence) AS licence
  FROM (SELECT licence, {_sql_folded("text")} AS folded FROM known_texts) GROUP BY 1
),
folded AS (SELECT doc_id, {_sql_folded("text")} AS folded FROM documents),
units AS (
  SELECT doc_id, 'document' AS unit, 0::INTEGER AS line, {_sql_digest("folded")} AS digest FROM folded
  UNION ALL
  SELECT doc_id, 'line', i::INTEGER, {_sql_digest("string_split(folded, chr(10))[i]")}
  FROM (SELECT doc_id, folded, unnest(range(1, len(string_split(folded, chr(10))) + 1)) AS i FROM folded)
)
SELECT u.doc_id, u.unit, u.line, u.digest, k.licence
FROM units u LEFT JOIN known k ON k.digest = u.digest
WHERE u.unit = 'document' OR k.licence IS NOT NULL
"""


SCAN_SQL = scan_sql(list(KNOWN.items()))
