import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import scans
from paperloom.operators import blocks as B
from paperloom.operators import chunks as C
from paperloom.operators import integrity, pictures, review
from paperloom.operators import lines as L
from paperloom.plans import documents, gates, settings
from paperloom.sources import readers


def test_section_paths_follow_the_stack(spark):
    r = random.Random(1)
    rows, want = [], {}
    for d in range(40):
        stack = []
        for i in range(25):
            level = r.randint(1, 6) if r.random() < 0.6 else None
            if level:
                stack = [*stack[: level - 1], f"h{i}"]
            rows.append((d, i, level is not None, level, f"h{i}"))
            want[d, i] = list(stack)
    df = spark.createDataFrame(rows, "d int, i int, h boolean, level int, t string")
    got = scans.section_paths(df, "d", "i", "h", "level", "t", 30).collect()
    assert {(x.d, x.i): x.section_path for x in got} == want


def test_greedy_pairs(spark):
    r = random.Random(2)
    rows, want = [], set()
    for d in range(50):
        flags = [r.random() < 0.7 for _ in range(20)]
        i = 0
        while i < 20:
            if flags[i]:
                want.add((d, i))
                i += 2
            else:
                i += 1
        rows += [(d, i, f) for i, f in enumerate(flags)]
    got = scans.odd_in_run(spark.createDataFrame(rows, "d int, i int, f boolean"), "f", ["d"], ["i"]).where("fires").collect()
    assert {(x.d, x.i) for x in got} == want


def test_reading_order_walks_groups_and_takes_each_ref_once(spark):
    edges = [(1, None, "a", 0), (1, None, "g", 1), (1, None, "z", 2), (1, "g", "b", 0), (1, "g", "h", 1), (1, "h", "c", 0), (1, "h", "a", 1), (1, "z", "g", 0)]
    got = B.reading_order(spark.createDataFrame(edges, "doc_id int, parent string, ref string, pos int")).orderBy("path").collect()
    assert [x.ref for x in got] == ["a", "g", "b", "h", "c", "z"]


def test_reading_order_does_not_cut_deep_trees(spark):
    """A text below 34 groups is read; a reference back to an ancestor ends its branch."""
    edges = [(1, f"g{i - 1}" if i else None, f"g{i}", 0) for i in range(34)] + [(1, "g33", "text", 0), (1, "g33", "g1", 1)]
    got = B.reading_order(spark.createDataFrame(edges, "doc_id int, parent string, ref string, pos int")).orderBy("path").collect()
    assert [(x.ref, x.depth) for x in got] == [*((f"g{i}", i) for i in range(34)), ("text", 34)]


def items(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id int, ord int, label string, level int, text string")


def test_typing_and_code_runs(spark):
    df = items(spark, [("section_header", 2, "1.1 Scope"), ("text", None, "words"), ("section_header", 1, "apiVersion: v1"), ("text", None, "kind: Pod"), ("code", None, "spec"), ("text", None, "after words"), ("page_header", None, "x"), ("text", None, " "), ("list_item", None, "point"), ("code", None, "alone")])
    typed = {x.ord: x for x in B.typed(df).collect()}
    assert typed[0].level == 2 and typed[2].block_type == "code" and typed[2].reasons == ["code_like_heading"] and typed[4].block_type == "paragraph" and 6 not in typed and 7 not in typed
    out = B.coalesce_code(B.typed(df)).orderBy("ord").collect()
    assert [(x.block_type, x.text, x.n_items) for x in out] == [("heading", "1.1 Scope", 1), ("paragraph", "words", 1), ("code", "apiVersion: v1\nkind: Pod\nspec", 3), ("paragraph", "after words", 1), ("list_item", "point", 1), ("paragraph", "alone", 1)]
    assert out[2].integrity_status == "verified" and out[2].reasons == []


def test_mixed_columns(spark):
    rows = [(1, i, 1, x, x + 100, 800.0) for i, x in enumerate([50.0, 500.0, 60.0, 510.0])] + [(1, i, 2, x, x + 100, 800.0) for i, x in enumerate([50.0, 500.0, 510.0])]
    got = {x.page: x for x in B.mixed_column_pages(spark.createDataFrame(rows, "doc_id int, ord int, page int, left double, right double, page_width double")).collect()}
    assert got[1].ambiguous and got[1].switches == 3 and not got[2].ambiguous


def test_split_words_drops_a_prefix_that_is_too_long(spark):
    df = spark.createDataFrame([(1, "h " * 18 + "\nend", " ".join(f"w{i}" for i in range(18))), (2, None, "a b"), (3, "x", None)], "id int, p string, t string")
    rows = C.split_words(df, "t", F.col("p"), 10).orderBy("id", "segment_index").collect()
    one = [x for x in rows if x.id == 1]
    assert all(x.token_count <= 10 for x in rows) and " ".join(x.segment for x in one).split() == [f"w{i}" for i in range(18)] and len(one) == 2
    assert [x.id for x in rows] == [1, 1, 2]


def sequential_pack(text, limit):
    """The greedy loop, one unit at a time."""
    import re

    if len(text.split()) <= limit:
        return [text]
    units = list(filter(None, re.split(r"\n{2,}|(?<=[?!.])\s+", text)))
    units = units if len(units) > 1 else re.findall("[^ \n]+[ \n]*", text)
    pieces, now = [], None
    for u in units:
        if now is None:
            now = u
            continue
        longer = now + (" " if now.strip()[-1:] in tuple("?!.") else "") + u
        if len(longer.split()) > limit:
            pieces.append(now.strip())
            now = u
        else:
            now = longer
    return [*pieces, now.strip()] if now is not None else pieces


def test_sentence_packing_is_the_greedy_loop(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["a b. ", "word ", "no end\n\n", "x! ", "long tail of words? ", "q"]) for _ in range(r.randint(1, 40))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for x in C.pack_sentences(df, "t", 12).orderBy("i", "piece_index").collect():
        got.setdefault(x.i, []).append(x)
    for i, t in enumerate(texts):
        want = sequential_pack(t, 12)
        assert [x.piece for x in got.get(i, [])] == ([] if not t.strip() else want), t
        assert [x.token_count for x in got.get(i, [])] == [len(p.split()) for p in want if t.strip()]


def test_clean_feed(spark):
    rows = [(1, 0, "heading", "H", ["H"], None, None, "verified"), (1, 1, "paragraph", "Permission =", ["H"], None, None, "verified"), (1, 2, "paragraph", "modules:read", ["H"], None, None, "verified"), (1, 3, "table", "", ["H"], ["A", ""], [["1", "2"], ["3", ""]], "verified"), (1, 4, "paragraph", "unsure", ["H"], None, None, "review_required"), (1, 5, "code", "a = 1\nb = 2", ["H"], None, None, "verified")]
    df = spark.createDataFrame([(*r, f"block-{r[1]:05d}") for r in rows], "doc_id int, ord int, block_type string, text string, section_path array<string>, headers array<string>, rows array<array<string>>, integrity_status string, block_id string")
    got = C.clean_chunks(df).orderBy("chunk_idx").collect()
    assert [(x.content_type, x.text) for x in got] == [("text", "H\nPermission = modules:read"), ("table_row", "H\nA = 1; Column 2 = 2"), ("table_row", "H\nA = 3"), ("code", "H\na = 1\nb = 2")]


def fragments(spark, a, b, head_b=False, page_b=2):
    """Two tables of one document on neighbouring pages; each is (rows, has header)."""
    cells, tables = [], []
    for t, (rows, head, page, top, bottom) in enumerate([(*a, 1, 400.0, 40.0), (*b, page_b, 760.0, 500.0)]):
        tables.append((1, t, f"#/tables/{t}", page, top, bottom, len(rows), len(rows[0]), 800.0, 500.0))
        cells += [(1, t, v, i, i + 1, j, j + 1, head and i == 0, 50.0 * j, 50.0 * j + 40) for i, r in enumerate(rows) for j, v in enumerate(r)]
    ts = spark.createDataFrame(tables, "doc_id int, table_idx int, ref string, page int, top double, bottom double, num_rows int, num_cols int, page_height double, page_width double")
    cs = spark.createDataFrame(cells, "doc_id int, table_idx int, text string, start_row int, end_row int, start_col int, end_col int, column_header boolean, left double, right double")
    return integrity.snapshots(ts, cs)


HEAD = ["Key", "Description"]


@pytest.mark.parametrize(
    "a, b, page_b, want",
    [
        (([HEAD, ["a", "b"]], True), ([["c", "d"], ["e", "f"]], False), 2, {"missing_continuation_header"}),
        (([HEAD], True), ([["c", "d"]], False), 2, {"header_only_fragment_continuation"}),
        (([["c", "d"]], False), ([HEAD, ["x", "y"]], True), 2, {"synthetic_numeric_headers"}),
        (([["Alert", "Threshol d"], ["c", "d"]], True), ([HEAD, ["x", "y"]], True), 2, {"wrapped_header_fragments"}),
        (([HEAD, ["a_", "b"]], True), ([["c", "d"], ["e", "f"]], False), 2, {"missing_continuation_header", "explicit_row_split"}),
        (([HEAD, ["a", "b"]], True), ([["c", "d"]], False), 4, {"synthetic_numeric_headers"}),
        (([HEAD, ["a", "b"]], True), ([["Other", "Titles"], ["e", "f"]], True), 2, set()),
    ],
)
def test_integrity_rules(spark, a, b, page_b, want):
    snaps = fragments(spark, a, b, page_b=page_b)
    found = integrity.analyze(snaps).collect()
    assert {x.category for x in found} == want and sorted(x.finding_id for x in found) == [f"si-{i + 1:04d}" for i in range(len(found))]
    report = integrity.report(snaps, integrity.analyze(snaps)).first()
    assert report.readiness == ("review_required" if "synthetic_numeric_headers" in want else "ready")
    if want == {"missing_continuation_header"}:
        fixed = {x.table_idx: x.rows for x in integrity.repaired_grids(snaps).collect()}
        assert fixed[1] == [HEAD, ["c", "d"], ["e", "f"]] and snaps.where("table_idx = 1").first().grid == [["c", "d"], ["e", "f"]]


def test_every_finding_of_a_page_break_and_its_repair(spark):
    """Columns that don't fit, repeated headers, split rows and wrapped headers: reported, and done where so reported."""
    def run(a, b):
        snaps = fragments(spark, a, b)
        found = integrity.analyze(snaps)
        got = [(x.category, x.status, x.tables) for x in found.orderBy("finding_id").collect()]
        rows = [x.rows for x in integrity.repaired_grids(snaps).orderBy("table_idx").collect()]
        return got, rows, integrity.report(snaps, found).first().readiness

    got, rows, readiness = run(([HEAD, ["a", "b"]], True), ([["Key", "Value", "Note"], ["c", "d", "e"]], True))
    assert got == [("ambiguous_table_boundary", "review_required", [0, 1])] and readiness == "review_required"
    assert rows == [[HEAD, ["a", "b"]], [["Key", "Value", "Note"], ["c", "d", "e"]]]
    got, rows, readiness = run(([HEAD, ["a", "b"]], True), ([["key", "Description:"], ["c", "d"]], True))
    assert got == [("repeated_continuation_header", "verified", [0, 1])] and readiness == "ready"
    got, rows, _ = run(([HEAD, ["a_", "b"]], True), ([HEAD, ["c", "d"], ["e", "f"]], True))
    assert [x[0] for x in got] == ["repeated_continuation_header", "explicit_row_split"] and rows == [[HEAD, ["a_c", "b d"]], [HEAD, ["e", "f"]]]
    got, rows, _ = run(([HEAD, ["a", "b"]], True), ([["", "d"], ["e", "f"]], False))
    assert [x[0] for x in got] == ["missing_continuation_header", "explicit_row_split"] and rows == [[HEAD, ["a", "b d"]], [HEAD, ["e", "f"]]]
    got, rows, _ = run(([["Alert", "Threshol d"], ["c", "d"]], True), ([HEAD, ["x", "y"]], True))
    assert [x[:2] for x in got] == [("wrapped_header_fragments", "repaired_high_confidence")] and rows[0] == [["Alert", "Threshold"], ["c", "d"]]


def test_a_row_cut_twice_loses_nothing(spark):
    rows = [[HEAD, ["a_", "b"]], [HEAD, ["c_", "d"]], [HEAD, ["e", "f"]]]
    cells, tables = [], []
    for t, own in enumerate(rows):
        tables.append((1, t, f"#/tables/{t}", t + 1, 760.0, 40.0, 2, 2, 800.0, 500.0))
        cells += [(1, t, v, i, i + 1, j, j + 1, i == 0, 50.0 * j, 50.0 * j + 40) for i, r in enumerate(own) for j, v in enumerate(r)]
    ts = spark.createDataFrame(tables, "doc_id int, table_idx int, ref string, page int, top double, bottom double, num_rows int, num_cols int, page_height double, page_width double")
    cs = spark.createDataFrame(cells, "doc_id int, table_idx int, text string, start_row int, end_row int, start_col int, end_col int, column_header boolean, left double, right double")
    snaps = integrity.snapshots(ts, cs)
    splits = [(x.status, x.tables) for x in integrity.analyze(snaps).where("category = 'explicit_row_split'").orderBy("finding_id").collect()]
    assert splits == [("repaired_high_confidence", [0, 1]), ("review_required", [1, 2])]
    assert [x.rows for x in integrity.repaired_grids(snaps).orderBy("table_idx").collect()] == [[HEAD, ["a_c_", "b d"]], [HEAD], [HEAD, ["e", "f"]]]


def test_grid_expands_spans_and_the_last_cell_wins(spark):
    cells = spark.createDataFrame([(1, 0, "wide", 0, 1, 0, 2, True, 0), (1, 0, "x", 1, 2, 0, 1, False, 1), (1, 0, "y", 1, 2, 1, 2, False, 2), (1, 0, "z", 1, 2, 1, 2, False, 3)], "doc_id int, table_idx int, text string, start_row int, end_row int, start_col int, end_col int, column_header boolean, cell_ord int")
    assert [(x["values"], x.is_header) for x in integrity.grid(cells).orderBy("row").collect()] == [(["wide", "wide"], True), (["x", "z"], False)]


def test_annotation(spark):
    chunks = spark.createDataFrame([(1, 0, ["r1"], "t"), (1, 1, ["r2"], "u"), (1, 2, [], "v")], "doc_id int, chunk_idx int, refs array<string>, text string")
    found = spark.createDataFrame([(1, "si-0001", "review_required", "r1", "check"), (1, "si-0002", "preserved", "r1", "p"), (1, "si-0003", "repaired_high_confidence", "r2", "q")], "doc_id int, finding_id string, status string, ref string, warning string")
    got = integrity.annotate(chunks, found).orderBy("chunk_idx").collect()
    assert [(x.text, x.integrity_status, x.integrity_finding_ids) for x in got] == [("[Review required: check]\nt", "review_required", ["si-0001", "si-0002"]), ("u", "repaired_high_confidence", ["si-0003"]), ("v", "verified", [])]


def test_coverage_of_pictures(spark):
    rows = [(0, 800, 600, False, True, "done", ""), (1, 800, 600, False, True, "failed", None), (2, 800, 600, False, False, "done", "x"), (3, 10, 10, False, True, "done", "x"), (4, 5, 5, True, True, None, None), (5, 800, 600, True, False, None, None), (6, 800, 600, False, True, "done", "React SPA Frontend and Express Backend"), (7, 800, 600, False, True, None, None), (8, 800, 600, False, True, "done", "Ate pes eee Ser")]
    df = spark.createDataFrame([(1, *r[:5], True, *r[5:]) for r in rows], "doc_id int, pic_idx int, width int, height int, structured boolean, has_file boolean, matched boolean, ocr_status string, ocr_text string")
    assert [x.coverage_status for x in pictures.coverage(df).orderBy("pic_idx").collect()] == "ocr_empty ocr_failed missing_exported_asset below_threshold structured_text missing_exported_asset ocr_text ocr_unavailable ocr_low_quality".split()
    capped = [x.coverage_status for x in pictures.coverage(df, limit=2).orderBy("pic_idx").collect()]
    assert capped[6:] == ["ocr_limit_exceeded"] * 3


def test_files_match_by_number(spark):
    pics = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "doc_id int, pic_idx int")
    files = spark.createDataFrame([(1, "picture-0001.png"), (1, "picture-0003.png")], "doc_id int, file string")
    assert [x.has_file for x in pictures.match_files(pics, files).orderBy("pic_idx").collect()] == [True, False, True]


def test_selection_of_candidates(spark):
    rows = [("ai-0001", 10, "e1"), ("ai-0002", 50, "e1"), ("ai-0003", 40, ""), ("ai-0004", 5, "e4"), ("ai-0005", 40, None), ("ai-0006", 1, "e4")]
    got = {x.candidate_id: x for x in review.select(spark.createDataFrame([(1, *r) for r in rows], "run int, candidate_id string, score int, evidence string"), 3, ["run"]).collect()}
    assert {k for k, x in got.items() if x.selected} == {"ai-0002", "ai-0003", "ai-0005"}
    assert got["ai-0001"].reason == "duplicate_evidence" and got["ai-0004"].reason == got["ai-0006"].reason == "candidate_limit"


def test_budget_stops_and_stays_stopped(spark):
    df = spark.createDataFrame([(1, i, 20_000, c) for i, c in enumerate([10.5, 0.0, 0.0])] + [(2, i, 1, 0.1) for i in range(4)], "run int, i int, tokens int, cost double")
    got = {(x.run, x.i): x.stop for x in review.guard(df, "run", "i", 3, 60_000, 5.0, 1.0).collect()}
    assert [got[1, i] for i in range(3)] == [None, "budget_limit", "budget_limit"] and [got[2, i] for i in range(4)] == [None, None, None, "request_limit"]
    usage = spark.range(1).select(review.cost(F.lit(10_000), F.lit(5_000), F.lit(5_000), 1.5, 9.0, 100.0).alias("c")).first().c
    assert abs(usage - 10.5) < 1e-9


def test_circuit_opens_for_good(spark):
    df = spark.createDataFrame([(1, 0, "Error code: 404"), (1, 1, None), (1, 2, "bad JSON"), (2, 0, "bad JSON"), (2, 1, None)], "run int, i int, error string")
    assert [x.attempted for x in review.circuit(df, "run", "i").orderBy("run", "i").collect()] == [True, False, False, True, True]


def test_claims_and_verdicts(spark):
    one = spark.sql("""select array('c1', 'c2') ids, array(named_struct('claim_id', 'c2', 'verdict', 'verified', 'evidence', array(0)), named_struct('claim_id', 'c1', 'verdict', 'rejected', 'evidence', array())) good,
      array(named_struct('claim_id', 'c1', 'verdict', 'verified', 'evidence', array(0))) short, array(named_struct('index', 0, 'box', array(0, 0, 10, 1000)), named_struct('index', 1, 'box', array())) regions, array(named_struct('index', 0, 'box', array(20, 0, 10, 5))) bad""")
    r = one.select(review.valid_verification(F.col("ids"), F.col("good")).alias("a"), review.valid_verification(F.col("ids"), F.col("short")).alias("b"), review.valid_regions(F.col("regions"), F.lit(2)).alias("c"), review.valid_regions(F.col("regions"), F.lit(1)).alias("d"), review.valid_regions(F.col("bad"), F.lit(1)).alias("e")).first()
    assert tuple(r) == (True, False, True, False, False)


def test_tiles(spark):
    r = spark.range(1).select(review.tiles(F.lit(1600), F.lit(1000), F.lit("users pk owner_id")).alias("a"), review.tiles(F.lit(5000), F.lit(500), F.lit("")).alias("b"), review.tiles(F.lit(10), F.lit(10), F.lit(None)).alias("c")).first()
    assert r.a.strategy == "full_plus_erd_tiles" and r.a.boxes == [[0, 0, 1600, 1000], [0, 0, 848, 1000], [752, 0, 1600, 1000]]
    assert r.b.strategy == "tiled_extreme_aspect" and len(r.b.boxes) == 3 and r.b.boxes[0] == [0, 0, 1766, 500] and r.c.strategy == "single_image"


def test_overlays_and_supplements(spark):
    blocks = spark.createDataFrame([(1, "b1", "paragraph", None, "ambiguous"), (1, "b2", "picture", None, "verified")], "doc_id int, block_id string, block_type string, level int, integrity_status string")
    over = spark.createDataFrame([(1, "b1", "heading", 9), (1, "b2", "heading", 1)], "doc_id int, block_id string, new_type string, new_level int")
    got = {x.block_id: x for x in review.overlay(blocks, over).collect()}
    assert (got["b1"].block_type, got["b1"].level, got["b1"].integrity_status) == ("heading", 6, "ai_verified") and got["b2"].block_type == "picture"
    claims = spark.createDataFrame([(1, "ai-0001", "c1", "said"), (1, "ai-0001", "c2", "other")], "doc_id int, candidate_id string, claim_id string, statement string")
    verdicts = spark.createDataFrame([(1, "ai-0001", "c1", "verified", "better"), (1, "ai-0001", "c2", "rejected", None)], "doc_id int, candidate_id string, claim_id string, verdict string, corrected_statement string")
    assert [x.statement for x in review.supplements(claims, verdicts).collect()] == ["better"]


def ref(name):
    return {"$ref": f"#/{name}"}


def item(name, **more):
    return {"self_ref": f"#/{name}", **more}


def cell(row, col, value, header=False):
    return dict(text=value, start_row_offset_idx=row, end_row_offset_idx=row + 1, start_col_offset_idx=col, end_col_offset_idx=col + 1, column_header=header)


GRAPH = json.dumps(
    dict(
        body=dict(children=[ref("texts/0"), ref("groups/0"), ref("tables/0"), ref("texts/2")]),
        texts=[item("texts/0", label="section_header", level=1, text="1. Intro", children=[]), item("texts/1", label="list_item", text="first point", children=[]), item("texts/2", label="text", text="Closing words.", children=[ref("pictures/0")])],
        groups=[item("groups/0", children=[ref("texts/1")])],
        tables=[item("tables/0", prov=[dict(page_no=1, bbox=dict(l=0, t=400, r=100, b=40))], data=dict(num_rows=2, num_cols=2, table_cells=[cell(0, 0, "Key", True), cell(0, 1, "Value", True), cell(1, 0, "a"), cell(1, 1, "b")]))],
        pictures=[item("pictures/0", parent=ref("texts/2"), children=[], image=dict(uri="p1.png", size=dict(width=800, height=600)))],
        pages={"1": dict(size=dict(width=500, height=800))},
    )
)


def test_a_document_graph_end_to_end(spark, tmp_path):
    (tmp_path / "one.json").write_text(GRAPH)
    out = documents.run_graphs(readers.read_graphs(spark, str(tmp_path)))
    md = out.markdown.first().markdown
    assert md == "# 1. Intro\n\n- first point\n\n| Key | Value |\n| --- | --- |\n| a | b |\n\nClosing words.\n\n![Picture](p1.png)\n\n> **Review required:** no verified text of this picture (ocr_unavailable); look at the picture itself."
    assert [(x.content_type, x.text) for x in out.clean_chunks.orderBy("chunk_idx").collect()] == [("text", "1. Intro\nfirst point"), ("table_row", "1. Intro\nKey = a; Value = b"), ("text", "1. Intro\nClosing words.")]
    gate = out.gates.first()
    assert gate.clean_readiness == "partial_ready" and gate.integrity_readiness == "ready" and gate.visual_readiness == "review_required"
    assert [r.category for r in out.findings.collect()] == ["unverified_picture_text"]
    assert out.core_chunks.first().headings == ["1. Intro"]


def test_pictures_and_columns_of_a_graph(spark, tmp_path):
    """Picture text, coverage, findings, warnings, adjacency, furniture and mixed columns reach the results of a run."""
    box = lambda left, right, t=700, b=600: [dict(page_no=1, bbox=dict(l=left, r=right, t=t, b=b))]
    texts = [item("texts/0", label="section_header", level=1, text="1. Intro", prov=box(0, 200))]
    texts += [item(f"texts/{i}", label="text", text=f"Column text {i} stands here.", prov=box(*((0, 200) if i % 2 else (300, 500)))) for i in range(1, 6)]
    texts += [item("texts/6", label="section_header", level=4, text="Order Queue"), item("texts/7", label="text", text="The service retries three times."), item("texts/8", label="page_footer", text="Page 1")]
    grid = dict(num_rows=2, num_cols=1, table_cells=[cell(0, 0, "Key", True), cell(1, 0, "a")])
    graph = dict(
        body=dict(children=[*(ref(f"texts/{i}") for i in range(6)), ref("pictures/0"), ref("tables/0"), ref("texts/8"), ref("tables/1"), ref("pictures/1"), ref("texts/8")]),
        texts=texts, groups=[],
        tables=[item("tables/0", prov=[dict(page_no=1, bbox=dict(l=0, t=400, r=100, b=40))], data=grid), item("tables/1", prov=[dict(page_no=2, bbox=dict(l=0, t=760, r=100, b=500))], data=grid)],
        pictures=[item("pictures/0", children=[ref("texts/6"), ref("texts/7"), ref("texts/8")], image=dict(uri="p1.png", size=dict(width=800, height=600))), item("pictures/1", children=[], image=dict(uri="p2.png", size=dict(width=800, height=600)))],
        pages={"1": dict(size=dict(width=500, height=800)), "2": dict(size=dict(width=500, height=800))},
    )
    (tmp_path / "one.json").write_text(json.dumps(graph))
    out = documents.run_graphs(readers.read_graphs(spark, str(tmp_path)))
    cov = {r.pic_idx: r for r in out.coverage.collect()}
    assert cov[0].coverage_status == "structured_text" and cov[1].coverage_status == "ocr_unavailable" and cov[0].context_heading == "1. Intro" and cov[0].heading_ceiling == 2
    rec = out.picture_records.first()
    assert rec.text == "Order Queue\nThe service retries three times." and [i.level for i in rec["items"]] == [2, None] and rec.refs == ["#/pictures/0", "#/texts/0", "#/texts/6", "#/texts/7"]
    found = {(r.category, r.status, r.ref) for r in out.findings.collect()}
    assert found == {("repeated_continuation_header", "verified", "#/tables/0"), ("repeated_continuation_header", "verified", "#/tables/1"), ("unverified_picture_text", "review_required", "#/pictures/1")}
    md = out.markdown.first().markdown
    assert "![Picture](p1.png)\n\n## Order Queue\n\n> **Picture text** (document, trust medium)\n> The service retries three times." in md and md.count("Order Queue") == 1 and "![Picture](p2.png)\n\n> **Review required:**" in md
    gate = out.gates.first()
    assert gate.visual_readiness == "review_required" and gate.integrity_readiness == "ready" and gate.clean_readiness == "partial_ready"
    assert {r.integrity_status for r in out.blocks.where("block_type = 'paragraph'").collect()} == {"ambiguous"}
    assert {r.kind for r in out.candidates.collect()} == {"diagram", "structural_ambiguity"}
    assert out.picture_chunks.count() == 1 and out.warning_chunks.count() == 1
    assert out.core_chunks.count() >= 1
    seen = spark.createDataFrame([("file", "#/pictures/1", "done", "React SPA Frontend and Express Backend")], "doc_id string, ref string, ocr_status string, ocr_text string").withColumn("doc_id", F.lit(out.gates.first().doc_id))
    again = documents.run_graphs(readers.read_graphs(spark, str(tmp_path)), ocr=seen)
    assert {r.category for r in again.findings.where("ref like '%pictures%'").collect()} == {"low_trust_picture_ocr"} and again.warning_chunks.count() == 0 and again.gates.first().visual_readiness == "review_required"


def test_web_pages_and_converter_markdown_end_to_end(spark):
    pages = spark.createDataFrame([("a", "<h1>Head</h1><p>Some &amp; words.</p><li>point</li>"), ("b", None)], "doc_id string, html string")
    out = documents.run_html(pages)
    assert out.markdown.first().markdown == "# Head\n\nSome & words.\n\n- point" and {r.doc_id: r.clean_readiness for r in out.gates.collect()} == {"a": "ready", "b": "blocked"}
    docs = spark.createDataFrame([(1, "## 1.2Title here\n#### Width:\nA &amp; B")], "doc_id int, text string")
    assert documents.run_markdown(docs, clean=True).markdown.first().markdown == "## 1.2 Title here\n\nWidth:\n\nA & B"


def test_converter_markdown_is_repaired_as_a_whole(spark):
    md = "# Head &amp; Foot\n\n| Alert | Threshol d |\n| --- | --- |\n| a | b |\n\nbetween\n\n| Alert | Threshol d |\n| --- | --- |\n|  | c |\n| d | e |\n\n# Page title\nx"
    docs = spark.createDataFrame([(1, md), (2, md)], "doc_id int, text string")
    items = spark.createDataFrame([(1, "section_header", "Head & Foot", 3, 1, 500.0, 480.0), (1, "page_header", "Page title", None, 1, 790.0, 780.0)], "doc_id int, label string, text string, level int, page_no int, top double, bottom double")
    pages = spark.createDataFrame([(1, 1, 800.0)], "doc_id int, page_no int, height double")
    tables = spark.createDataFrame([(1, 0, 1, 400.0, 40.0, 800.0), (1, 1, 2, 760.0, 500.0, 800.0), (2, 0, 1, 400.0, 40.0, 800.0)], "doc_id int, table_idx int, page int, top double, bottom double, page_height double").withColumn("next_page_height", F.lit(800.0))
    got = {r.doc_id: r.markdown for r in L.clean_markdown(docs, items, pages, tables).collect()}
    one = "| Alert | Threshold |\n| --- | --- |\n"
    assert got[1] == f"### Head & Foot\n\n{one}| a | b c |\n| d | e |\n\nbetween\n\n\n\nx\n"
    assert got[2] == f"# Head & Foot\n\n{one}| a | b |\n\nbetween\n\n{one}|  | c |\n| d | e |\n\n# Page title\nx\n"


def test_markdown_end_to_end(spark):
    docs = spark.createDataFrame([("d", "# Title\nSome words.\n- point\n```\nx = 1\n```\n"), ("e", "")], "doc_id string, text string")
    out = documents.run_markdown(docs)
    assert [x.text for x in out.clean_chunks.orderBy("chunk_idx").collect()][:2] == ["Title\nSome words.", "Title\npoint"]
    assert {x.doc_id: x.clean_readiness for x in out.gates.collect()} == {"d": "ready", "e": "blocked"}


def test_settings():
    assert settings.profile("scanned").force_full_page_ocr and not settings.profile("standard").force_full_page_ocr and settings.profile("visual").chart_extraction
    with pytest.raises(ValueError):
        settings.profile("other")
    s = settings.review_settings(env={"PAPERLOOM_REVIEW_ENABLED": "Yes", "PAPERLOOM_REVIEW_CANDIDATES": "1000", "PAPERLOOM_REVIEW_REQUESTS": "x"})
    assert s.enabled and not s.usable and s.max_candidates == 100 and s.max_requests == 7 and "api_key" not in s.public()


def test_evaluation_and_scope(spark):
    good = {k: 1 for k in gates.SCORES}
    df = spark.createDataFrame([(1, good), (2, {**good, "overall": 3}), (3, {"x": 1})], "i int, s map<string,int>")
    got = [x.e for x in df.select("i", gates.evaluation(F.col("s")).alias("e")).orderBy("i").collect()]
    assert [(x.total, x.error) for x in got] == [(7, None), (None, "range"), (None, "fields")]
    chunks = spark.createDataFrame([(1, "page"), (1, "section_only"), (2, "unavailable")], "doc_id int, provenance_scope string")
    assert {x.doc_id: x.provenance_scope for x in gates.provenance_scope(chunks).collect()} == {1: "section_only", 2: "unavailable"}
