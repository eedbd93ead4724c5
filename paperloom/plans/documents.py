"""The run as one plan: Markdown, web pages, DOCX files or document graphs to chunks, queue and gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import blocks as B
from ..operators import chunks as C
from ..operators import integrity
from ..operators import lines as L
from ..operators import pictures as P
from ..operators import review
from ..sources import files, readers
from . import gates
from .stage import staged

FINDING = "doc_id string, finding_id string, category string, status string, blocks_llm_readiness boolean, ref string, message string"
_TEXTS = "array<string>"


@dataclass
class Outputs:
    """Results of a run: blocks and findings are staged tables, the others lazy plans over them. Without pictures their tables are None."""

    blocks: DataFrame
    findings: DataFrame
    candidates: DataFrame
    clean_chunks: DataFrame
    core_chunks: DataFrame
    review_queue: DataFrame
    markdown: DataFrame
    gates: DataFrame
    warning_chunks: DataFrame
    coverage: DataFrame | None = None
    picture_records: DataFrame | None = None
    picture_chunks: DataFrame | None = None


def _finish(
    documents: DataFrame, blocks: DataFrame, findings: DataFrame, results: DataFrame | None, limit: int,
    overlays: DataFrame | None = None, supplements: DataFrame | None = None, coverage: DataFrame | None = None, records: DataFrame | None = None,
) -> Outputs:
    spark = documents.sparkSession
    blocks = staged(B.numbered(B.attach_findings(blocks, findings)), "blocks")
    hints = records if records is not None else spark.createDataFrame([], "doc_id string, asset_uri string, text string")
    cand = B.candidates(blocks, findings, hints)
    if results is None:
        results = spark.createDataFrame([], "doc_id string, candidate_id string, status string")
    final = review.overlay(blocks, overlays) if overlays is not None else blocks
    clean = C.clean_chunks(final, supplements, limit)
    queue = C.review_queue(cand, results, final)
    core = integrity.annotate(C.core_chunks(final, limit), findings.withColumn("warning", F.col("message")))
    markdown = B.markdown(final)
    if coverage is not None:
        shown = P.inject_warnings(P.inject_text(L.to_lines(markdown, "markdown"), records), coverage)
        markdown = L.to_text(shown)
    own = findings if coverage is None else findings.where("finding_id not like 'vi-%'")
    ready = gates.gates(integrity.report(documents, own.dropDuplicates(["doc_id", "finding_id"])), C.readiness(documents, clean, queue), coverage)
    warned = findings.withColumn("requires_standalone_warning", F.col("category") != "low_trust_picture_ocr").dropDuplicates(["doc_id", "finding_id"])
    pictures = C.picture_chunks(records, limit) if records is not None else None
    return Outputs(blocks, findings, cand, clean, core, queue, markdown, ready, C.warning_chunks(warned), coverage, records, pictures)


def _flat(blocks: DataFrame) -> DataFrame:
    """Blocks without pages and pictures, with the columns of all blocks."""
    empty = {"asset_uri": F.lit(None).cast("string"), "headers": F.lit(None).cast(_TEXTS), "rows": F.lit(None).cast(f"array<{_TEXTS}>")}
    return blocks.withColumns({"refs": F.array(F.concat(F.lit("#/lines/"), F.col("ord").cast("string"))), **{k: v for k, v in empty.items() if k not in blocks.columns}})


def run_items(docs: DataFrame, items: DataFrame, results: DataFrame | None = None, limit: int = C.MAX_TOKENS, **more: DataFrame) -> Outputs:
    """Items (doc_id, ord, label, text, level) of any flat format through typing, code runs, sections, chunks and gates."""
    blocks = _flat(B.with_sections(B.coalesce_code(B.typed(items))))
    return _finish(docs, blocks, docs.sparkSession.createDataFrame([], FINDING), results, limit, **more)


def run_markdown(docs: DataFrame, results: DataFrame | None = None, limit: int = C.MAX_TOKENS, clean: bool = False, **more: DataFrame) -> Outputs:
    """Markdown or plain texts (doc_id, text). ``clean``: as it comes from a converter, so entities, headings and tables are repaired first."""
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    if clean:
        docs = staged(L.clean_markdown(docs).withColumnRenamed("markdown", "text"), "cleaned")
    return run_items(docs, readers.markdown_items(docs), results, limit, **more)


def run_html(pages: DataFrame, results: DataFrame | None = None, limit: int = C.MAX_TOKENS, **more: DataFrame) -> Outputs:
    """Web pages (doc_id, html) by their headings, paragraphs and list items."""
    docs = pages.select(F.col("doc_id").cast("string").alias("doc_id"), "html")
    found = readers.html_blocks(docs.withColumnRenamed("doc_id", "page_id")).withColumnRenamed("page_id", "doc_id")
    label = F.when(F.col("block_type") == "heading", "section_header").when(F.col("block_type") == "list_item", "list_item").otherwise("text")
    return run_items(docs, found.select("doc_id", "ord", label.alias("label"), "text", "level"), results, limit, **more)


def run_docx(found: DataFrame, results: DataFrame | None = None, limit: int = C.MAX_TOKENS, **more: DataFrame) -> Outputs:
    """DOCX files (path, content) in their own order: paragraphs, headings, code runs, lists and tables; a file that can't be read is blocked."""
    docs = found.select(F.col("path").alias("doc_id"))
    b = files.docx_blocks(files.docx_items(found)).withColumnRenamed("path", "doc_id")
    head = F.when(F.col("kind") == "table", F.get("rows", F.lit(0)))
    b = b.select(
        "doc_id", "ord", "block_type", F.when(F.col("block_type") == "code", "code").otherwise("text").alias("label"), "text", "level", F.lit("verified").alias("integrity_status"),
        F.array().cast(_TEXTS).alias("reasons"), head.alias("headers"), F.when(F.col("kind") == "table", F.slice("rows", 2, 1 << 30)).alias("rows"),
    )
    return _finish(docs, _flat(B.with_sections(B.coalesce_code(b))), found.sparkSession.createDataFrame([], FINDING), results, limit, **more)


def _pages(graphs: DataFrame) -> DataFrame:
    p = graphs.select("doc_id", F.explode("pages").alias("n", "p"))
    return p.select("doc_id", F.col("n").cast("int").alias("page_no"), F.col("p.size.height").alias("height"), F.col("p.size.width").alias("width"))


def graph_pictures(graphs: DataFrame, items: DataFrame, furniture: DataFrame, picture_files: DataFrame | None = None, ocr: DataFrame | None = None) -> DataFrame:
    """One row per picture: size, place, children as items, context and coverage.

    ``picture_files``: doc_id, file of what was exported (without it a URI counts as a file); ``ocr``: doc_id, ref,
    ocr_status, ocr_text of an outside reader.
    """
    p = graphs.select("doc_id", F.posexplode("pictures").alias("pic_idx", "i"))
    p = p.select(
        "doc_id", "pic_idx", F.col("i.self_ref").alias("ref"), F.col("i.parent")["$ref"].alias("parent_ref"), F.col("i.image.uri").alias("asset_uri"), F.col("i.image.size.width").alias("width"),
        F.col("i.image.size.height").alias("height"), F.get(F.col("i.prov"), F.lit(0))["page_no"].alias("page"), F.transform(F.coalesce("i.children", F.array()), lambda c: c["$ref"]).alias("children"),
    )
    p = P.match_files(p, picture_files) if picture_files is not None else p.withColumns({"has_file": F.col("asset_uri").isNotNull(), "file": F.regexp_extract("asset_uri", "([^/]*)$", 1)})
    p = p.withColumn("picture_file", F.coalesce("file", text.picture_name(F.col("ref"))))
    body = readers.graph_edges(graphs).where("parent is null").select("doc_id", "ref", F.col("pos").alias("ord")).join(items.select("doc_id", "ref", "label", "text", "level"), ["doc_id", "ref"])
    p = p.join(P.nearest_heading(body, furniture).select("doc_id", "ref", "context_heading", "context_ref", "heading_ceiling"), ["doc_id", "ref"], "left")
    kids = P.child_items(p, items.where("kind = 'text'"), furniture)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "label", "level", "text", "ref"))), lambda x: F.struct(x["label"].alias("label"), x["level"].alias("level"), x["text"].alias("text"), x["ref"].alias("ref")))
    own = kids.groupBy("doc_id", "pic_idx").agg(parts.alias("items"))
    useful = P.useful_structured(kids.select("doc_id", F.col("pic_idx").alias("ref"), "label", "text")).withColumnRenamed("ref", "pic_idx")
    p = p.join(own, ["doc_id", "pic_idx"], "left").join(useful, ["doc_id", "pic_idx"], "left").withColumn("structured", F.coalesce("structured", F.lit(False)))
    p = p.join(ocr.select("doc_id", "ref", "ocr_status", "ocr_text"), ["doc_id", "ref"], "left") if ocr is not None else p.withColumns({"ocr_status": F.lit(None).cast("string"), "ocr_text": F.lit(None).cast("string")})
    return P.coverage(p.withColumn("matched", F.lit(True)))


def picture_records(coverage: DataFrame) -> DataFrame:
    """doc_id, rec_idx, asset_uri, picture_file, page, source, trust, items, refs and text of the pictures whose text is known."""
    known = coverage.where("coverage_status in ('structured_text', 'ocr_text')")
    structured = F.col("coverage_status") == "structured_text"
    body = F.when(structured, F.array_join(F.transform("items", lambda i: i["text"]), "\n")).otherwise(text.clean_ocr(F.col("ocr_text")))
    refs = P.source_refs(F.col("ref"), F.array("context_ref"), F.transform("items", lambda i: i["ref"]), F.col("asset_uri"))
    plain = F.transform("items", lambda i: F.struct(i["label"].alias("label"), i["level"].alias("level"), i["text"].alias("text")))
    return known.select("doc_id", F.col("pic_idx").alias("rec_idx"), "asset_uri", "picture_file", "page", "source", "trust", F.when(structured, plain).alias("items"), refs.alias("refs"), "context_heading", body.alias("text"))


def run_graphs(
    graphs: DataFrame, results: DataFrame | None = None, limit: int = C.MAX_TOKENS, use_repaired_tables: bool = False,
    picture_files: DataFrame | None = None, ocr: DataFrame | None = None, overlays: DataFrame | None = None, supplements: DataFrame | None = None,
) -> Outputs:
    """Document graphs (readers.read_graphs) through reading order, typing, table integrity, pictures, chunks and gates."""
    edges = readers.graph_edges(graphs)
    order = B.reading_order(edges)
    items = readers.graph_items(graphs).join(order, ["doc_id", "ref"]).withColumn("ord", F.row_number().over(B.scans.ordered("doc_id", "path")) - 1)
    items = staged(items.withColumnRenamed("page_no", "page"), "items")
    pages = _pages(graphs)
    furniture = staged(L.furniture(items.select("doc_id", "label", "text", F.col("page").alias("page_no"), F.col("box.t").alias("top"), F.col("box.b").alias("bottom")), pages), "furniture")
    snaps = integrity.snapshots(readers.graph_tables(graphs), readers.graph_cells(graphs))
    snaps = staged(integrity.with_adjacency(snaps, edges.where("parent is null").join(items.select("doc_id", "ref", "label"), ["doc_id", "ref"], "left")), "tables")
    found = integrity.analyze(snaps)
    refs = snaps.select("doc_id", F.col("table_idx").alias("t"), "ref")
    semantic = found.select("*", F.explode("tables").alias("t")).join(refs, ["doc_id", "t"]).withColumn("message", F.col("category"))
    coverage = staged(graph_pictures(graphs, items, furniture, picture_files, ocr), "pictures")
    columns = [c.split()[0] for c in FINDING.split(", ")]
    findings = staged(semantic.select(*columns).unionByName(P.picture_findings(coverage).select(*columns)), "findings")
    texts = B.typed(items.where("kind = 'text'")).withColumn("refs", F.array("ref"))
    inside = coverage.select("doc_id", F.explode("children").alias("ref")).distinct()
    texts = texts.join(inside, ["doc_id", "ref"], "left_anti")  # they are the picture's text
    grid = integrity.grid(readers.graph_cells(graphs), expand_spans=False)
    rows = grid.groupBy("doc_id", "table_idx").agg(F.array_sort(F.collect_list(F.struct("row", "values", "is_header"))).alias("g"))
    if use_repaired_tables:
        fixed = integrity.repaired_grids(snaps).select("doc_id", "table_idx", "rows")
        rows = rows.join(fixed, ["doc_id", "table_idx"]).select("doc_id", "table_idx", F.transform("rows", lambda v, i: F.struct(i.alias("row"), v.alias("values"), (i == 0).alias("is_header"))).alias("g"))
    head = F.coalesce(F.array_max(F.transform(F.filter("g", lambda r: r["is_header"]), lambda r: r["row"])), F.lit(0))
    rows = rows.withColumn("_h", head).select("doc_id", "table_idx", F.get("g", F.col("_h"))["values"].alias("headers"), F.transform(F.slice("g", F.col("_h") + 2, F.lit(1 << 30)), lambda r: r["values"]).alias("rows"))
    tables = items.where("kind = 'table'").join(refs.withColumnRenamed("t", "table_idx"), ["doc_id", "ref"]).join(rows, ["doc_id", "table_idx"], "left").drop("table_idx")
    tables = tables.withColumns({"block_type": F.lit("table"), "refs": F.array("ref"), "integrity_status": F.lit("verified"), "reasons": F.array().cast(_TEXTS)})
    placed = items.join(pages.select("doc_id", F.col("page_no").alias("page"), F.col("width").alias("page_width")), ["doc_id", "page"]).select("doc_id", "ord", "page", F.col("box.l").alias("left"), F.col("box.r").alias("right"), "page_width")
    blocks = B.mark_mixed_columns(texts.unionByName(tables, allowMissingColumns=True), B.mixed_column_pages(placed))
    blocks = staged(B.with_sections(B.coalesce_code(blocks)), "sections")
    blocks = B.insert_pictures(blocks, coverage.select("doc_id", "pic_idx", "ref", "parent_ref", "asset_uri"))
    return _finish(graphs, blocks, findings, results, limit, overlays, supplements, coverage, picture_records(coverage))
