from codewarden.llm import licences
from tests.llm.helpers import EDGES, docs


def found(spark, rows, texts=None):
    rows = licences.scan(docs(spark, rows, extra=True), licences.known_licences(spark, texts)).collect()
    return {(r.doc_id, r.unit, r.line, r.licence) for r in rows if r.licence}, rows


def test_case_punctuation_copyright_lines_and_spellings(spark):
    mit = licences.KNOWN["MIT"]
    spelled = mit.replace("sublicense", "sub-licence").replace("COPYRIGHT HOLDERS", "copyright owners").replace(" ", " \t ").replace("and", "\n and")
    rows = [
        (1, mit),
        (2, f"Copyright (c) 2020 Somebody\n\n{spelled.upper()}"),
        (3, mit + " And more."),
        (4, f"(C) 1999 me\n{licences.KNOWN['ISC']}"),
        (5, f"Some text.\nLicenced under the apache licence, version 2.0\nMore."),
        (6, "Mere prose about copyright and licence."),
    ]
    got, _ = found(spark, rows)
    assert got == {
        (1, "document", 0, "MIT"),
        (2, "document", 0, "MIT"),
        (4, "document", 0, "ISC"),
        (5, "line", 2, "Apache-2.0-notice"),
    }


def test_a_notice_alone_is_document_and_line(spark):
    got, _ = found(spark, [(1, "Released under the MIT License."), (1, "Released under the MIT License.")])
    assert got == {(1, "document", 0, "MIT-notice"), (1, "line", 1, "MIT-notice")}


def test_edges(spark):
    got, rows = found(spark, [*EDGES, (8, "Copyright 2020 me")], {"b": "Word!", "a": "WORD", "none": "(c) nobody"})
    assert len([r for r in rows if r.unit == "document"]) == len(EDGES) + 1
    assert got == {(4, "document", 0, "a"), (4, "line", 1, "a")}
    assert sum(r.licence is not None for r in rows) == 4
    assert {r.digest is None for r in rows if r.unit == "document" and r.doc_id == 1} == {True}
    assert found(spark, [])[1] == []


def test_known_texts_are_told_apart(spark):
    assert licences.known_licences(spark).count() == len(licences.KNOWN)


def test_every_notice_line_of_the_documents_is_known(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = documents.selectExpr("explode(split(text, '\n')) AS text").filter(r"text rlike '(?i)\\blicen[sc]ed under|released under'")
    lines = [r.text for r in lines.filter("length(text) < 100").distinct().collect()]
    assert "Licensed under CC BY-NC 4.0." in lines and len(lines) == 4
    got, _ = found(spark, list(enumerate(lines)), licences.public_licences())
    named = {lines[i]: licence for i, unit, _, licence in got if unit == "line"}
    assert sorted(named) == sorted(lines) and named["Licensed under CC BY-NC 4.0."] == "CC-BY-NC-4.0-notice"


def test_public_texts_with_and_without_titles(spark):
    by_file = {f.name: f.read_text() for f in licences.resources.files("codewarden.llm").joinpath("licence_texts").iterdir()}
    gpl, apache, bsd = (by_file[f"{n}.txt"] for n in ("GPL-3.0", "Apache-2.0", "BSD-3-Clause"))
    rows = [
        (1, f"MIT License\n\nCopyright (c) 2020 Somebody\n\n{licences.KNOWN['MIT']}"),
        (2, gpl),
        (3, gpl.strip().partition("\n\n")[2].upper()),
        (4, apache[: apache.index("APPENDIX: How")]),
        (5, f"BSD 3-Clause License\n\nCopyright (c) 2020, me\nAll rights reserved.\n\n{bsd.partition('.')[2].strip()}"),
        (6, "# SPDX-License-Identifier: GPL-2.0-or-later"),
        (7, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
        (8, "// SPDX-License-Identifier: MPL-2.0"),
        (9, f"MIT License for some\n{licences.KNOWN['MIT']}"),
    ]
    got, _ = found(spark, rows, licences.public_licences())
    assert {(i, licence) for i, unit, _, licence in got if unit == "document"} == {
        (1, "MIT"), (2, "GPL-3.0"), (3, "GPL-3.0"), (4, "Apache-2.0"), (5, "BSD-3-Clause"),
        (6, "GPL-2.0-notice"), (7, "CC-BY-NC-4.0-notice"), (8, "MPL-2.0-notice"),
    }


def test_public_texts_name_one_licence_each(spark):
    rows = spark.createDataFrame(licences.public_licences(), "licence string, text string")
    form = licences.digest(licences.canonical(licences.F.col("text"))).alias("digest")
    several = rows.select(form, "licence").distinct().groupBy("digest").agg(licences.F.collect_set("licence").alias("l"))
    assert several.filter("size(l) > 1").collect() == []


def test_equal_words_in_a_row_and_no_shuffle_of_lines(spark):
    form = spark.range(1).select(licences.canonical(licences.F.lit("licence licence licence sub licence sub-licence\n\nlicence")).alias("f"))
    assert form.first().f == "license license license sublicense sublicense license"
    scanned = licences.scan(docs(spark, [(1, "Word\n\n\nWord")]), licences.known_licences(spark))
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
