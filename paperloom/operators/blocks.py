"""Canonical blocks: reading order, typing, sections, code runs, pictures, review candidates and Markdown.

Blocks: doc_id, ord, block_type (heading, paragraph, list_item, code, table, picture), text, level, refs, pages,
integrity_status, reasons, headers, rows, and asset_uri for pictures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scans, text

#: A tree of references deeper than this raises an error; nothing is cut off.
DEEPEST = 1000


def reading_order(edges: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(doc_id, ref, depth, path): depth-first order of a tree of references; each ref once, at its first place.

    ``edges``: doc_id, parent (null at the root), ref, pos. One equi-join for each level of the tree, until a level
    adds nothing; a reference back to one of its own ancestors is not followed. Sort by path.
    """
    e = edges.select("doc_id", "parent", "ref", F.format_string("%06d", F.col("pos").cast("int")).alias("_p"))
    level = e.where("parent is null").select("doc_id", "ref", F.lit(0).alias("depth"), F.col("_p").alias("path"))
    spark = edges.sparkSession
    name = f"edges_{id(edges)}"
    e.createOrReplaceTempView(name)
    level.createOrReplaceTempView(f"{name}_root")
    walked = spark.sql(f"""
        with recursive walk(doc_id, ref, depth, path, above) max recursion level {deepest} as (
          select doc_id, ref, depth, path, array(ref) from {name}_root
          union all
          select e.doc_id, e.ref, w.depth + 1, concat(w.path, '/', e._p), concat(w.above, array(e.ref)) from walk w join {name} e on e.doc_id = w.doc_id and e.parent = w.ref where not array_contains(w.above, e.ref))
        select doc_id, ref, depth, path from walk""")
    return walked.groupBy("doc_id", "ref").agg(F.min_by("depth", "path").alias("depth"), F.min("path").alias("path"))


def matched_refs(native: DataFrame, items: DataFrame) -> DataFrame:
    """``native`` (doc_id, ord, signature, ...) with the ref of the item of equal signature whose turn it is, null where there is none left.

    ``items``: doc_id, ord, signature, ref. The first of equal texts takes the first ref, the second the second: both sides
    are numbered within a signature, and the rest is an equi-join.
    """
    turn = lambda df: df.withColumn("_t", F.row_number().over(Window.partitionBy("doc_id", "signature").orderBy("ord")))
    return turn(native).join(turn(items).select("doc_id", "signature", "_t", "ref"), ["doc_id", "signature", "_t"], "left").drop("_t")


def typed(items: DataFrame) -> DataFrame:
    """Items (doc_id, ord, label, text, level, ...) as blocks; page furniture and empty texts go.

    A number at the start of a heading decides its level (a differing one is a reason for review); a heading that looks
    like source code is code; an item labelled code starts as a paragraph and joins a run of code later.
    """
    df = items.where(~F.col("label").isin("page_header", "page_footer") & (text.strip(F.col("text")) != ""))
    head = F.col("label").isin("section_header", "title")
    code = head & text.is_code_start(F.col("text"))
    number = text.canonical_level(F.col("text"))
    level = F.when(head & ~code, F.greatest(F.lit(1), F.least(F.coalesce(number, F.col("level"), F.lit(1)), F.lit(6))))
    kind = F.when(code, "code").when(head, "heading").when(F.col("label") == "list_item", "list_item").otherwise("paragraph")
    reasons = F.filter(
        F.array(F.when(head & ~code & number.isNotNull() & (number != F.col("level")), "heading_hierarchy_mismatch"), F.when(code, "code_like_heading")), lambda x: x.isNotNull()
    )
    return df.withColumns({"block_type": kind, "level": level, "reasons": reasons}).withColumn("integrity_status", F.when(F.size("reasons") > 0, "ambiguous").otherwise("verified"))


def with_sections(blocks: DataFrame) -> DataFrame:
    """Adds section_path; a heading's own path ends in itself."""
    df = blocks.withColumn("_h", F.col("block_type") == "heading")
    return scans.section_paths(df, "doc_id", "ord", "_h", "level", "text").drop("_h", "depth")


def coalesce_code(blocks: DataFrame) -> DataFrame:
    """Runs of code as one block: a code block takes in what follows while it is code or carries code on.

    A run of several items is verified and loses its reasons; pages are those of the first.
    """
    w = scans.ordered("doc_id", "ord")
    start = F.col("block_type") == "code"
    follows = start | ((F.col("label") == "code") | text.continues_code(F.col("text"))) & F.col("block_type").isin("paragraph", "list_item")
    df = blocks.withColumn("_start", start).withColumn("_ok", follows)
    # a run of follow-ups counts from its first true code block on
    df = df.withColumn("_run", scans.island(F.col("_ok"), w))
    inner = Window.partitionBy("doc_id", "_run").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_in", F.col("_ok") & F.max("_start").over(inner))
    df = df.withColumn("_key", F.when(F.col("_in"), F.concat(F.lit("r"), F.col("_run").cast("string"))).otherwise(F.concat(F.lit("b"), F.col("ord").cast("string"))))
    keep = [c for c in blocks.columns if c not in ("doc_id", "ord", "text", "block_type", "integrity_status", "reasons")]
    out = df.groupBy("doc_id", "_key").agg(
        F.min("ord").alias("ord"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.when(F.first("_in"), "code").otherwise(F.first("block_type")).alias("block_type"),
        F.when(F.count(F.lit(1)) > 1, "verified").otherwise(F.first("integrity_status")).alias("integrity_status"),
        F.when(F.count(F.lit(1)) > 1, F.array().cast("array<string>")).otherwise(F.first("reasons")).alias("reasons"),
        F.count(F.lit(1)).alias("n_items"),
        *(F.min_by(c, "ord").alias(c) for c in keep),
    )
    return out.drop("_key")


def numbered(blocks: DataFrame) -> DataFrame:
    """Adds block_id block-00001... in order."""
    return blocks.withColumn("block_id", F.format_string("block-%05d", F.row_number().over(scans.ordered("doc_id", "ord"))))


def mixed_column_pages(items: DataFrame) -> DataFrame:
    """(doc_id, page, switches, ambiguous): a page on which reading order jumps between the halves three times or more.

    ``items``: doc_id, ord, page, left, right, page_width.
    """
    side = F.when((F.col("left") + F.col("right")) / 2 < F.col("page_width") / 2, "left").otherwise("right")
    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    df = items.where("left is not null and right is not null").withColumn("_s", side).withColumn("_c", F.coalesce((F.lag("_s").over(w) != F.col("_s")).cast("int"), F.lit(0)))
    out = df.groupBy("doc_id", "page").agg(F.sum("_c").alias("switches"), F.count_distinct("_s").alias("_n"))
    return out.withColumn("ambiguous", (F.col("switches") >= 3) & (F.col("_n") == 2)).drop("_n")


def mark_mixed_columns(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks (with page) of ambiguous pages get the status ambiguous and a reason."""
    bad = pages.where("ambiguous").select("doc_id", "page", F.lit(True).alias("_bad"))
    df = blocks.join(bad, ["doc_id", "page"], "left")
    return df.withColumns(
        {
            "integrity_status": F.when(F.col("_bad"), "ambiguous").otherwise(F.col("integrity_status")),
            "reasons": F.when(F.col("_bad"), F.array_union("reasons", F.array(F.lit("mixed_column_order")))).otherwise(F.col("reasons")),
        }
    ).drop("_bad")


def insert_pictures(blocks: DataFrame, pictures: DataFrame) -> DataFrame:
    """Blocks and pictures in one order: a picture after the first block that holds its parent's ref, the rest at the end.

    ``pictures``: doc_id, pic_idx, ref, parent_ref, asset_uri. Adds anchor_matched for pictures.
    """
    anchors = blocks.select("doc_id", "ord", "section_path", F.explode("refs").alias("parent_ref")).groupBy("doc_id", "parent_ref").agg(F.min("ord").alias("_at"), F.min_by("section_path", "ord").alias("section_path"))
    pics = pictures.join(anchors, ["doc_id", "parent_ref"], "left").withColumn("anchor_matched", F.col("_at").isNotNull())
    pics = pics.select(
        "doc_id", F.coalesce(F.col("_at").cast("long"), F.lit((1 << 62))).alias("_a"), (F.col("pic_idx") + 1).alias("_b"), F.lit("picture").alias("block_type"), F.lit("").alias("text"), F.array("ref").alias("refs"), "asset_uri", "section_path", "anchor_matched"
    )
    out = blocks.withColumns({"_a": F.col("ord").cast("long"), "_b": F.lit(0)}).unionByName(pics, allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("_a", "_b")
    return out.withColumn("ord", F.row_number().over(w) - 1).withColumn("integrity_status", F.coalesce("integrity_status", F.lit("verified"))).drop("_a", "_b")


def attach_findings(blocks: DataFrame, findings: DataFrame) -> DataFrame:
    """Blocks with the findings on their refs: ids always; review_required and the categories if one blocks or needs review.

    ``findings``: doc_id, finding_id, category, status, blocks_llm_readiness, ref.
    """
    hit = blocks.select("doc_id", "ord", F.explode("refs").alias("ref")).join(findings, ["doc_id", "ref"])
    bad = (F.col("status") == "review_required") | F.col("blocks_llm_readiness")
    per = hit.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_set("finding_id")).alias("integrity_finding_ids"), F.array_sort(F.collect_set(F.when(bad, F.col("category")))).alias("_c"), F.max(bad).alias("_bad"))
    df = blocks.join(per, ["doc_id", "ord"], "left")
    return df.withColumns(
        {
            "integrity_finding_ids": F.coalesce("integrity_finding_ids", F.array().cast("array<string>")),
            "integrity_status": F.when(F.col("_bad"), "review_required").otherwise(F.col("integrity_status")),
            "reasons": F.when(F.col("_bad"), F.array_union(F.coalesce("reasons", F.array().cast("array<string>")), "_c")).otherwise(F.col("reasons")),
        }
    ).drop("_c", "_bad")


def candidates(blocks: DataFrame, findings: DataFrame, picture_records: DataFrame) -> DataFrame:
    """What a reviewer should look at, ai-0001... per document: diagrams with text or a finding, unclear blocks, then findings on refs that no block holds."""
    pics = blocks.where("block_type = 'picture'").join(picture_records.select("doc_id", "asset_uri", F.col("text").alias("ocr_hint")), ["doc_id", "asset_uri"], "left")
    pics = pics.where(F.col("ocr_hint").isNotNull() | (F.size("integrity_finding_ids") > 0))
    a = pics.select("doc_id", F.lit(0).alias("_k"), F.col("ord").cast("string").alias("_o"), F.lit("diagram").alias("kind"), "block_id", F.lit(None).cast("string").alias("finding_id"), "refs", F.coalesce("ocr_hint", F.lit("")).alias("ocr_hint"), "reasons")
    unclear = blocks.where("block_type <> 'picture' and integrity_status in ('ambiguous', 'review_required')")
    b = unclear.select("doc_id", F.lit(1).alias("_k"), F.format_string("%08d", "ord").alias("_o"), F.lit("structural_ambiguity").alias("kind"), "block_id", F.lit(None).cast("string").alias("finding_id"), "refs", F.lit("").alias("ocr_hint"), "reasons")
    known = blocks.select("doc_id", F.explode("refs").alias("ref")).distinct()
    rest = findings.where("status = 'review_required' and ref is not null").join(known, ["doc_id", "ref"], "left_anti")
    c = rest.select("doc_id", F.lit(2).alias("_k"), F.col("finding_id").alias("_o"), F.lit("pdf_semantic_ambiguity").alias("kind"), F.lit(None).cast("string").alias("block_id"), "finding_id", F.array("ref").alias("refs"), F.lit("").alias("ocr_hint"), F.array("category").alias("reasons"))
    a = a.withColumn("_o", F.lpad("_o", 8, "0"))
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("_k", "_o"))
    return a.unionByName(b).unionByName(c).withColumn("candidate_id", F.format_string("ai-%04d", turn)).drop("_k", "_o")


def markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown): blocks of each document in order. Uses headers, rows and language where they are there."""
    has = set(blocks.columns)
    line = F.when(F.col("block_type") == "heading", F.concat(F.repeat(F.lit("#"), F.least("level", F.lit(6))), F.lit(" "), "text"))
    line = line.when(F.col("block_type") == "list_item", F.concat(F.lit("- "), "text"))
    line = line.when(F.col("block_type") == "code", F.concat(F.lit("```"), F.when(text.code_language(F.col("text")) == "text", "").otherwise(text.code_language(F.col("text"))), F.lit("\n"), "text", F.lit("\n```")))
    if "headers" in has:
        cells = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x: text.escape_cell(x, True)), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.transform("headers", lambda _: F.lit("---")), " | "), F.lit(" |"))
        line = line.when(F.col("block_type") == "table", F.array_join(F.concat(F.array(cells(F.col("headers")), rule), F.transform("rows", cells)), "\n"))
    if "asset_uri" in has:
        line = line.when(F.col("block_type") == "picture", F.concat(F.lit("![Picture]("), "asset_uri", F.lit(")")))
    df = blocks.select("doc_id", "ord", line.otherwise(F.col("text")).alias("line")).where("line is not null")
    return df.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n\n").alias("markdown"))
