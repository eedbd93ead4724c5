import pytest
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import lines as L


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (text.sanitize_stem, {"../in/Delivery note (v2)!.pdf": "Delivery-note-v2", "...": "document", "a/b/.hidden": "hidden", "x.tar.gz": "x.tar", "y" * 99 + ".md": "y" * 80}),
    (text.text_signature, {"Straße 12, É!": "strasse12", "": ""}),
    (text.loose_signature, {"Été_1 – Maß": "été_1mass"}),
    (text.normalize_entities, {"&amp;lt; &nbsp;x": "<  x"}),
    (text.is_false_sentence_heading, {"8-Nov-2025": True, "One two three four five.": True, "One two.": False, "2025/1/2": True}),
    (text.is_false_label_heading, {"Width:": True, "Width": False, "· Date": True, "Length:": False}),
    (text.bare_label, {"· Date": "Date"}),
    (text.normalize_sentence, {"The order then goes on to Step 4 -Packing of parcels .": "The order then goes on to Step 4 - Packing of parcels."}),
    (text.numbered_heading, {"2. Architecture": "## 2. Architecture", "2.1 Scope": "### 2.1 Scope", "Scope": None, "1.2.3.4.5.6.7 Deep": "###### 1.2.3.4.5.6.7 Deep"}),
    (text.canonical_level, {"2. A": 1, "7.6.2. B": 3, "no": None}),
    (text.join_header_fragment, {"Threshol d": "Threshold", "Model A": "Model A", "Type 1": "Type 1"}),
    (text.code_language, {"apiVersion: v1": "yaml", "pipeline {": "groovy", "docker run x": "bash", "plain words": "text", "key: value": "yaml"}),
    (text.picture_name, {"#/pictures/0": "picture-0001.png", "none": None}),
    (text.needs_value, {"Permission =": True, "a: ": True, "a": False}),
    (text.parse_row, {"| a | b\\|c |  |": ["a", "b|c", ""]}),
    (text.strip_emphasis, {"**a** __b__ \\*c\\_": "a b *c_"}),
    (text.clean_ocr, {"Add Spectator\nan\noo\nAI": "Add Spectator\nAI"}),
    (text.has_useful_ocr, {"Ate pes eee Ser": False, "React SPA Frontend\nExpress Backend\nPostgreSQL\nAI": True, "": False}),
    (text.is_code_start, {"FROM node": True, "# comment": True, "word": False}),
]


@pytest.mark.parametrize("f, cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_scalar(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_null_in_null_out(spark):
    for f, _ in CASES:
        assert values(spark, f, [None])[0] in (None, False, [], "text", "document"), f.__name__


def test_mime(spark):
    heads = [b"%PDF-1.7", b"\x89PNG\r\n\x1a\n1", b"\xff\xd8\xff1", b"II*\x001", b"BM1", b"RIFF0000WEBP", b"PK\x03\x04", b"text", b"a\x00b", b"\xff\xfe\xfa"]
    df = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(heads)], "i int, c binary")
    got = [r.m for r in df.select("i", text.mime_by_signature(F.col("c")).alias("m")).orderBy("i").collect()]
    assert got == ["application/pdf", "image/png", "image/jpeg", "image/tiff", "image/bmp", "image/webp", "application/zip", "text/plain", "application/octet-stream", "application/octet-stream"]


def clean(spark, md, **more):
    docs = spark.createDataFrame([(1, md)], "doc_id int, text string")
    return L.to_text(L.clean_headings(L.to_lines(docs), **more)).first().markdown


def test_heading_ladder(spark):
    cases = {
        "####### Width:": "Width:",
        "#### Width": "#### Width",
        "#### · Date": "Date",
        "## 3.2.1 Opening Hours 3.2.2 Closing Hours": "#### 3.2.1 Opening Hours\n#### 3.2.2 Closing Hours",
        "# of Virtual Machines (VMs)": "\\# of Virtual Machines (VMs)",
        "#### 8-Nov-2025": "8-Nov-2025",
        "# 1.2Title here": "### 1.2 Title here",
        "######## Deep": "###### Deep",
        "# ": "",
        "no heading": "no heading",
    }
    assert clean(spark, "\n".join(cases)) == "\n".join(cases.values())


def test_headings_know_the_document(spark):
    items = spark.createDataFrame([(1, "section_header", "Overview", 5), (1, "page_header", "Acme Corp", None), (1, "section_header", "Overview", 5), (1, "section_header", "Overview", 2)], "doc_id int, label string, text string, level int")
    code = spark.createDataFrame([(1, "# install the package now")], "doc_id int, text string")
    md = "###### Overview\n# Acme Corp\n```\n# in a fence\n```\n# Install the package"
    assert clean(spark, md, levels=L.heading_levels(items), furniture_=L.furniture(items), code_starts=code) == "##### Overview\n\n```\n# in a fence\n```\n\\# Install the package"


def test_tables_found_outside_fences(spark):
    md = "| A | B |\n| --- | --- |\n| 1 | 2 |\n| x |\n\n```\n| no | no |\n| --- | --- |\n```\n| C |\n| - |\n| D | E |\n|---|:--:|"
    docs = spark.createDataFrame([(1, md)], "doc_id int, text string")
    got = L.table_blocks(L.to_lines(docs)).orderBy("table_idx").collect()
    assert [(r.first_line, r.header, r.rows) for r in got] == [(0, ["A", "B"], [["1", "2"]])]


def test_continued_tables_merge_once(spark):
    head = ["Code", "Meaning", "Limit", "Level"]
    rows = [(1, 0, head, [["DISK_USAGE_", "Share of the volume in use", "> 90 for", "WARN"]], 10, 760.0, 50.0), (1, 1, head, [["HIGH", "", "five minutes", "ING"]], 11, 760.0, 40.0), (1, 2, head, [["x", "y", "z", "w"]], 12, 780.0, 300.0), (2, 0, head, [["a", "b", "c", "d"]], 1, 700.0, 300.0), (2, 1, head, [["e", "f", "g", "h"]], 2, 790.0, 300.0)]
    df = spark.createDataFrame([(*r, 800.0) for r in rows], "doc_id int, table_idx int, header array<string>, rows array<array<string>>, page int, top double, bottom double, page_height double")
    got = {(r.doc_id, r.table_idx): r for r in L.merge_continued_tables(df).collect()}
    assert sorted(got) == [(1, 0), (1, 2), (2, 0), (2, 1)]
    assert got[1, 0].merged and got[1, 0].rows == [["DISK_USAGE_HIGH", "Share of the volume in use", "> 90 for five minutes", "WARNING"]] and not got[1, 2].merged


def test_borderless_table(spark):
    md = "Intro\nCategory\nRequirement\nPerformance\nFast\n\nBackup & Recovery Daily backups\n# Next"
    out = L.borderless_tables(spark.createDataFrame([(1, md), (2, None)], "doc_id int, markdown string")).orderBy("doc_id").collect()
    assert out[0].markdown == "Intro\n\n| Category | Requirement |\n| --- | --- |\n| Performance | Fast |\n| Backup & Recovery | Daily backups |\n\n# Next\n" and out[1].markdown is None
