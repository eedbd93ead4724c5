import json
import zipfile

import pytest

from paperloom.sources import files
from paperloom.streaming import journal

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(path):
    def p(text, style="", extra="", run=""):
        s = f'<w:pStyle w:val="{style}"/>' if style else ""
        return f'<w:p><w:pPr>{s}{extra}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>'

    num = '<w:numPr><w:ilvl w:val="0"/></w:numPr>'
    table = f"<w:tbl><w:tr><w:tc>{p('A')}</w:tc><w:tc>{p('B')}</w:tc></w:tr><w:tr><w:tc>{p('1')}</w:tc><w:tc>{p('2')}</w:tc></w:tr></w:tbl>"
    body = p("Intro", "H1") + p("7.6.2. Scope", "H4") + p("Email must be valid", "H3", num) + p("point", "", num) + p("kubectl apply") + p("mono", run='<w:rFonts w:ascii="Consolas"/>') + p("2.1 Bold title", run="<w:b/>") + p("words") + table
    styles = "".join(f'<w:style w:styleId="H{i}"><w:name w:val="heading {i}"/></w:style>' for i in (1, 3, 4))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}">{styles}</w:styles>')


def test_files_are_checked(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_bytes(b"a\x00b")
    (tmp_path / "c.pdf").write_text("text")
    (tmp_path / "d.md").write_text("")
    (tmp_path / "e.exe").write_text("x")
    (tmp_path / "f.png").write_bytes(b"\x89PNG\r\n\x1a\n000")
    (tmp_path / "g.pptx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "h.html").write_text("<p>hi</p>")
    docx(tmp_path / "i.docx")
    found = files.read_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in files.check_office(files.validated(found)).collect()}
    assert {k: r.error for k, r in got.items()} == {"a.txt": None, "b.txt": "content_mismatch", "c.pdf": "content_mismatch", "d.md": "empty", "f.png": None, "g.pptx": "bad_container", "h.html": None, "i.docx": None}
    assert files.validated(found, max_size=1).where("error = 'too_large'").count() == 7
    assert [r.size_bytes for r in files.inventory(found).collect()][0] == 5


def test_docx(spark, tmp_path):
    docx(tmp_path / "i.docx")
    (tmp_path / "bad.docx").write_bytes(b"PK no")
    rows = files.docx_blocks(files.docx_items(files.read_files(spark, str(tmp_path)))).orderBy("ord").collect()
    assert [(r.block_type, r.level) for r in rows] == [("heading", 1), ("heading", 3), ("list_item", None), ("list_item", None), ("code", None), ("code", None), ("heading", 2), ("paragraph", None), ("table", None)]
    assert rows[-1].rows == [["A", "B"], ["1", "2"]]


def test_json_lines_have_no_infinities(spark, tmp_path):
    files.write_jsonl(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "i int, x double").coalesce(1), str(tmp_path / "o"), ["i"])
    lines = [json.loads(x) for p in (tmp_path / "o").glob("*.json") for x in p.read_text().splitlines()]
    assert lines == [{"i": 1}, {"i": 2, "x": 0.5}]


def test_journal_folds_in_batch_and_stream(spark, tmp_path):
    events = [{"run_id": "r", "sequence": i, "event": "e", "phase": p, "requests": q} for i, (p, q) in enumerate([("select", None), ("extract", 1), (None, 2), ("verify", None)])]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.jsonl").write_text("\n".join(json.dumps({k: v for k, v in e.items() if v is not None}) for e in events) + "\nnot json\n")
    batch = journal.fold(journal.read_journal(spark, str(tmp_path / "j"), stream=False)).first()
    assert (batch.last_sequence, batch.n_events, batch.phase, batch.requests) == (3, 4, "verify", 2)
    def fold_again():
        journal.run_to_files(journal.fold(journal.read_journal(spark, str(tmp_path / "j"))), str(tmp_path / "out"), str(tmp_path / "cp"))
        return {x.run_id: x for x in journal.latest(spark, str(tmp_path / "out"), "run_id").collect()}

    assert fold_again() == fold_again() == {"r": batch}
    (tmp_path / "j" / "b.jsonl").write_text(json.dumps({"run_id": "r", "sequence": 9, "event": "e", "status": "done"}) + "\n" + json.dumps({"run_id": "s", "sequence": 1, "event": "e"}))
    state = fold_again()
    assert state["r"] == journal.fold(journal.read_journal(spark, str(tmp_path / "j"), stream=False)).where("run_id = 'r'").first() and state["s"].n_events == 1


def test_the_shared_folder_is_this_applications_own_and_goes(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from paperloom.plans import stage

    assert spark.sparkContext.applicationId in stage.shared_dir(spark)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError):
        stage.shared_dir(cluster)
    (tmp_path / "x").mkdir()
    stage.removed(spark, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()
