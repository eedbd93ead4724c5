import json
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from paperloom.__main__ import main
from paperloom.operators import lines as L
from paperloom.operators import pictures
from paperloom.plans import gates, review_run, runs, settings


class Fake:
    """A reviewer that answers from a table; errors are raised."""

    def __init__(self, answers):
        self.answers, self.calls = answers, []

    def extract(self, c):
        self.calls.append(("extract", c["candidate_id"]))
        a = self.answers[c["candidate_id"]]
        if isinstance(a, Exception):
            raise a
        return {"candidate_id": c["candidate_id"], "claims": [{"claim_id": k, "statement": k.upper(), "evidence": [0]} for k in a]}, {"input_tokens": 1000, "output_tokens": 100}

    def verify(self, c, e):
        self.calls.append(("verify", c["candidate_id"]))
        return {"verdicts": [{"claim_id": k, "verdict": v, "evidence": [0]} for k, v in self.answers[c["candidate_id"]].items()]}, {"input_tokens": 1000}


def candidates(spark, n=3):
    return spark.createDataFrame([("d", f"ai-{i + 1:04d}", "structural_ambiguity", "", "", None) for i in range(n)], "doc_id string, candidate_id string, kind string, ocr_hint string, searchable string, evidence string")


def run(spark, answers, n=3, cache=None, **s):
    fake, events = Fake(answers), []
    out = review_run.run_review(candidates(spark, n), settings.ReviewSettings(enabled=True, api_key="k", **s), fake, cache, events.append, sleep=lambda _: None)
    return out[0], {r.candidate_id: r for r in out[1].collect()}, out[2].collect(), fake, events


def test_two_passes(spark):
    cache = {}
    answers = {"ai-0001": {"a": "verified"}, "ai-0002": {"a": "verified", "b": "rejected"}, "ai-0003": {}}
    status, results, claims, fake, events = run(spark, answers, cache=cache)
    assert status == "partial" and [results[k].status for k in sorted(results)] == ["verified", "partial", "unresolved"] and len(claims) == 3
    assert [e["sequence"] for e in events] == list(range(len(events)))
    assert run(spark, answers, cache=cache)[3].calls == []


def test_a_systemic_error_opens_the_circuit(spark):
    status, results, _, fake, _ = run(spark, {"ai-0001": RuntimeError("Error code: 404 not_found")})
    assert status == "failed" and len(fake.calls) == 1 and [results[k].attempted for k in sorted(results)] == [True, False, False]


def test_limits(spark):
    answers = {f"ai-{i:04d}": {"a": "verified"} for i in range(1, 4)}
    status, results, _, fake, _ = run(spark, answers, max_candidates=2, max_verifications=1)
    assert results["ai-0003"].reason == "candidate_limit" and results["ai-0002"].reason == "verification_limit" and len(fake.calls) == 3
    assert run(spark, answers, max_requests=1)[1]["ai-0001"].reason == "request_limit"
    assert run(spark, answers, budget=0.1, request_reserve=0.0)[1]["ai-0002"].reason == "budget_limit"
    cache = {}
    run(spark, answers, cache=cache, max_verifications=0)
    assert cache == {}


def test_transient_errors_are_tried_again(spark):
    status, results, _, fake, _ = run(spark, {"ai-0001": RuntimeError("503 unavailable")}, n=1)
    assert len(fake.calls) == 3 and results["ai-0001"].status == "failed"


def test_not_needed_and_not_configured(spark):
    assert run(spark, {}, n=0)[0] == "not_needed"
    status, results, _ = review_run.run_review(candidates(spark), settings.ReviewSettings(), None)
    assert status == "not_configured" and {r.reason for r in results.collect()} == {"not_configured"}


def test_manifest_and_evaluation(tmp_path):
    t = runs.Timings(callback=lambda e: 1 / 0)
    with t.stage("one"):
        pass
    t.skip("two", "no tables")
    with pytest.raises(ValueError), t.stage("three"):
        raise ValueError
    assert [s["status"] for s in t.stages.values()] == ["ran", "skipped", "failed"]
    m = runs.finished(runs.manifest({"path": "x"}, {}), t, {"n": 1}, [])
    assert m["status"] == "failed" and m["runtime"]["pyspark"] and runs.version("no-such-package") is None
    runs.new_evaluation(tmp_path)
    scores = dict.fromkeys(gates.SCORES, 2)
    assert json.loads(runs.save_evaluation(tmp_path, scores).read_text())["total"] == 14
    for bad in ({**scores, "overall": 3}, {**scores, "overall": True}, {"overall": 1}):
        with pytest.raises(ValueError):
            runs.save_evaluation(tmp_path, bad)
    runs.write_json(tmp_path / "n.json", {"x": float("nan"), "y": [float("inf"), 1]})
    assert json.loads((tmp_path / "n.json").read_text()) == {"x": None, "y": [None, 1]}
    assert sorted(zipfile.ZipFile(BytesIO(runs.archive(tmp_path))).namelist()) == ["evaluation.json", "n.json"]
    assert runs.preview("abc", 2) == ("ab", True)


def test_json_is_read_back_and_page_pictures_go(spark, tmp_path):
    runs.write_json(tmp_path / "a.json", {"x": ["é", None]})
    assert runs.read_json(tmp_path / "a.json") == {"x": ["é", None]}
    files = spark.createDataFrame([("r/assets/page_1.png", 5), ("r/assets/picture_1.png", 7), ("r/page_1.png", 9), ("assets/page_2.png", 2)], "path string, length long")
    kept, gone = runs.without_page_images(files)
    assert sorted(r.path for r in kept.collect()) == ["r/assets/picture_1.png", "r/page_1.png"] and tuple(gone.first()) == (2, 7)


def test_page_metric(spark):
    df = spark.createDataFrame([(".docx", None), (".docx", 3), (".pdf", 0)], "extension string, n_pages int")
    assert [r.pages_shown for r in runs.page_metric(df).collect()] == ["Unavailable", "3", "0"]


def test_warnings_and_children_of_pictures(spark):
    docs = spark.createDataFrame([(1, "a\n![x](p1.png)\n![x](p1.png)")], "doc_id int, text string")
    cov = spark.createDataFrame([(1, 0, "p1.png", True, "ocr_failed", "#/pictures/0"), (1, 1, "p2.png", True, "ocr_failed", "#/pictures/1"), (1, 2, "p1.png", False, "below_threshold", ""), (1, 3, "p1.png", True, "ocr_text", ""), (1, 4, "p1.png", True, "structured_text", "")], "doc_id int, pic_idx int, asset_uri string, qualifying boolean, coverage_status string, ref string")
    warning = "> **Review required:** no verified text of this picture (ocr_failed); look at the picture itself."
    assert L.to_text(pictures.inject_warnings(L.to_lines(docs), cov)).first().markdown == f"a\n![x](p1.png)\n\n{warning}\n![x](p1.png)\n\n## Unresolved Image Content\n\n### #/pictures/1\n{warning}"
    assert L.to_text(pictures.inject_warnings(L.to_lines(docs), cov.where("pic_idx > 1"))).first().markdown == "a\n![x](p1.png)\n![x](p1.png)"
    pics = spark.createDataFrame([(1, 0, ["r1", "r2", "r3", "r4", "r5"], 3), (2, 0, ["r1"], None)], "doc_id int, pic_idx int, children array<string>, heading_ceiling int")
    items = spark.createDataFrame([(1, "r1", "section_header", " t ", 5), (1, "r2", "page_header", "u", None), (1, "r3", "section_header", "low", 1), (1, "r4", "text", " ", None), (1, "r5", "text", "Page 1!", None), (2, "r1", "section_header", "t", 5)], "doc_id int, ref string, label string, text string, level int")
    known = spark.createDataFrame([(1, "page1")], "doc_id int, signature string")
    assert [(r.doc_id, r.ref, r.text, r.level) for r in pictures.child_items(pics, items, known).orderBy("doc_id", "pos").collect()] == [(1, "r1", "t", 3), (1, "r3", "low", 1), (2, "r1", "t", 5)]
    found = pictures.picture_findings(cov).orderBy("finding_id").collect()
    assert [(r.finding_id, r.category, r.ref) for r in found] == [("vi-0001", "unverified_picture_text", "#/pictures/0"), ("vi-0002", "unverified_picture_text", "#/pictures/1"), ("vi-0003", "low_trust_picture_ocr", "")]


def test_headings_of_picture_text_stand_once(spark):
    docs = spark.createDataFrame([(1, "# Known\n![x](p0.png)\nb\n![x](p1.png)")], "doc_id int, text string")
    items = "array<struct<label:string,level:int,text:string>>"
    rows = [(1, 0, "p0.png", "x", "document", "medium", [("section_header", 2, "KNOWN!"), ("section_header", 3, "New part"), ("text", None, "one\ntwo")]), (1, 1, "p1.png", "x", "document", "medium", [("section_header", 1, "new part"), ("section_header", None, "2.1 Numbered"), ("text", None, "three")]), (1, 2, "none.png", "four\n\nfive", "ocr", "low", None)]
    rec = spark.createDataFrame(rows, f"doc_id int, rec_idx int, asset_uri string, text string, source string, trust string, items {items}")
    head = "> **Picture text** ({}, trust {})"
    want = ["# Known", "![x](p0.png)", "", "### New part", "", head.format("document", "medium"), "> one", "> two", "b", "![x](p1.png)", "", "### 2.1 Numbered", "", head.format("document", "medium"), "> three", "", "## Extracted Image Text", "", head.format("ocr", "low"), "> four", ">", "> five"]
    assert L.to_text(pictures.inject_text(L.to_lines(docs), rec)).first().markdown.split("\n") == want


def test_source_refs(spark):
    r = spark.range(1).select(pictures.source_refs(F.lit("p"), F.array(F.lit("c"), F.lit("p")), F.lit(None).cast("array<string>"), F.lit("u")).alias("a"), pictures.source_refs(F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit("u")).alias("b")).first()
    assert r.a == ["p", "c"] and r.b == ["u"]


def test_command_line_takes_web_pages_and_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<h1>T</h1><p>Some words here.</p>")
    (tmp_path / "in" / "c.pdf").write_bytes(b"%PDF-1.4 x")
    with zipfile.ZipFile(tmp_path / "in" / "b.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:outlineLvl w:val="0"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Words of it.</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>K</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert main(["batch", str(tmp_path / "in"), "--output", str(tmp_path / "out")], spark) == 1
    m = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert m["counts"] == {"files": 3, "rejected": 0, "clean_chunks": 3, "not_converted": 1}
    assert {r.text for r in spark.read.json(f"{tmp_path}/out/docx/clean_chunks").collect()} == {"Head\nWords of it.", "Head\nK = v"}


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\nSome words here.")
    (tmp_path / "in" / "b.pdf").write_text("not a pdf")
    assert main(["batch", str(tmp_path / "in"), "--output", str(tmp_path / "out")], spark) == 1
    m = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert m["status"] == "partial_success" and m["counts"] == {"files": 2, "rejected": 1, "clean_chunks": 1, "not_converted": 0}
    assert main(["parse", str(tmp_path / "in" / "a.md"), "--output", str(tmp_path / "one")], spark) == 0
