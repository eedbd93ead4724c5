"""Pictures: which ones qualify, where their text comes from, its coverage status, context and placement in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scans, text
from .lines import with_fences

LEAST_AREA, LEAST_SIDE, OCR_LIMIT = 35_000, 50, 40


def qualifies(width: Column, height: Column) -> Column:
    """Large enough to hold text worth reading; unknown sizes are not."""
    return F.coalesce((width * height >= LEAST_AREA) & (F.least(width, height) >= LEAST_SIDE), F.lit(False))


def useful_structured(items: DataFrame) -> DataFrame:
    """(doc_id, ref, structured): 40 characters or 4 items, or a section header or code among them. ``items``: doc_id, ref of the picture, label, text."""
    own = items.groupBy("doc_id", "ref").agg(F.sum(F.length(text.strip(F.col("text")))).alias("_c"), F.count(F.lit(1)).alias("_n"), F.max(F.col("label").isin("section_header", "code")).alias("_h"))
    return own.select("doc_id", "ref", ((F.col("_c") >= 40) | (F.col("_n") >= 4) | F.col("_h")).alias("structured"))


def coverage(pictures: DataFrame, limit: int = OCR_LIMIT) -> DataFrame:
    """Adds qualifying, coverage_status, source and trust.

    ``pictures``: doc_id, pic_idx, width, height, structured (useful text in the document), has_file, matched (its
    reference is known), and ocr_status (null: no OCR there; failed, timeout or done) with ocr_text. A picture with
    structured text but no exported file is missing_exported_asset; it does not touch the others. At most ``limit``
    pictures of a document are read by OCR, in order.
    """
    df = pictures.withColumn("qualifying", qualifies(F.col("width"), F.col("height")))
    wants = F.col("qualifying") & ~F.col("structured") & F.col("has_file") & F.col("matched")
    w = scans.ordered("doc_id", "pic_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_turn", F.when(wants, F.sum(wants.cast("int")).over(w)))
    status = (
        F.when(F.col("structured") & ~F.col("has_file"), "missing_exported_asset")
        .when(F.col("structured"), "structured_text")
        .when(~F.col("qualifying"), "below_threshold")
        .when(~F.col("has_file"), "missing_exported_asset")
        .when(~F.col("matched"), "unmatched_source_reference")
        .when(F.col("_turn") > limit, "ocr_limit_exceeded")
        .when(F.col("ocr_status").isNull(), "ocr_unavailable")
        .when(F.col("ocr_status") == "timeout", "ocr_timeout")
        .when(F.col("ocr_status") == "failed", "ocr_failed")
        .when(text.strip(F.coalesce("ocr_text", F.lit(""))) == "", "ocr_empty")
        .when(text.has_useful_ocr(text.clean_ocr(F.col("ocr_text"))), "ocr_text")
        .otherwise("ocr_low_quality")
    )
    df = df.withColumn("coverage_status", status).drop("_turn")
    return df.withColumns(
        {
            "source": F.when(F.col("coverage_status") == "structured_text", "document").when(F.col("coverage_status") == "ocr_text", "ocr"),
            "trust": F.when(F.col("coverage_status") == "structured_text", "medium").when(F.col("coverage_status") == "ocr_text", "low"),
        }
    )


def nearest_heading(items: DataFrame, furniture: DataFrame | None = None) -> DataFrame:
    """Pictures among ``items`` (doc_id, ord, label, text, level) with the nearest earlier section header, its ref where items have one, and the deepest level for their own.

    Headers whose signature is in ``furniture`` (doc_id, signature) are passed over; for the level, so are those without one.
    """
    w = scans.ordered("doc_id", "ord")
    df = items.withColumn("_s", text.text_signature(F.col("text")))
    if furniture is not None:
        df = df.join(furniture.select("doc_id", F.col("signature").alias("_s"), F.lit(True).alias("_f")), ["doc_id", "_s"], "left")
    else:
        df = df.withColumn("_f", F.lit(None).cast("boolean"))
    head = (F.col("label") == "section_header") & F.col("_f").isNull()
    named = head & (text.strip(F.col("text")) != "")
    df = df.withColumn("context_heading", scans.previous(text.strip(F.col("text")), named, w))
    if "ref" in items.columns:
        df = df.withColumn("context_ref", scans.previous(F.col("ref"), named, w))
    df = df.withColumn("heading_ceiling", F.least(scans.previous(F.col("level"), head & F.col("level").isNotNull(), w) + 1, F.lit(6)))
    return df.where("label = 'picture'").drop("_s", "_f")


def match_files(pictures: DataFrame, files: DataFrame) -> DataFrame:
    """Pictures with their exported file, by the number in its name, so one that failed shifts no other."""
    n = files.select("doc_id", "file", (F.regexp_extract("file", r"(\d+)\.\w+$", 1).cast("int") - 1).alias("pic_idx"))
    return pictures.join(n, ["doc_id", "pic_idx"], "left").withColumn("has_file", F.col("file").isNotNull())


_URI = r"!\[[^\]]*\]\(([^)]*)\)"


def _first_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, asset_uri, line_no) of the first image line of each URI."""
    images = lines.select("doc_id", "line_no", F.nullif(F.regexp_extract("line", _URI, 1), F.lit("")).alias("asset_uri")).where("asset_uri is not null")
    return images.groupBy("doc_id", "asset_uri").agg(F.min("line_no").alias("line_no"))


def _put(lines: DataFrame, records: DataFrame, turn: str, title: str) -> DataFrame:
    """Lines with ``put`` (an array of lines) of each record after the first image line of its URI; what no line shows comes last, under ``title``."""
    rec = records.join(_first_lines(lines), ["doc_id", "asset_uri"], "left")
    rec = rec.join(lines.groupBy("doc_id").agg((F.max("line_no") + 1).alias("_end")), "doc_id", "left").withColumn("_end", F.coalesce("_end", F.lit(0)))
    placed = rec.select("doc_id", F.coalesce("line_no", F.col("_end") + 1).alias("_a"), (F.col(turn) + 1).alias("_b"), F.posexplode("put").alias("_c", "line"))
    heads = rec.where("line_no is null").select("doc_id", F.col("_end").alias("_a")).distinct().select("doc_id", "_a", F.lit(0).alias("_b"), F.posexplode(F.array(F.lit(""), F.lit(title))).alias("_c", "line"))
    out = lines.select("doc_id", F.col("line_no").alias("_a"), F.lit(0).alias("_b"), F.lit(0).alias("_c"), "line").unionByName(placed).unionByName(heads)
    return out.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("_a", "_b", "_c")) - 1).alias("line_no"), "line")


def inject_text(lines: DataFrame, records: DataFrame, title: str = "## Extracted Image Text") -> DataFrame:
    """Lines with each record's quoted text after the first image line of its URI, and the rest under ``title``.

    ``records``: doc_id, rec_idx, asset_uri, text, source, trust, and items (array of label, level, text) where the text has
    structure: section headers among them become headings before the quote, unless a heading of the same signature stands
    in the document or has been put there for an earlier record. An equi-join on the URI, never line by record.
    """
    records = records.where("text is not null and text <> ''")
    quote = lambda t: F.transform(F.split(t, "\n"), lambda x: F.when(x == "", F.lit(">")).otherwise(F.concat(F.lit("> "), x)))
    label = F.concat(F.lit("> **Picture text** ("), "source", F.lit(", trust "), "trust", F.lit(")"))
    if "items" not in records.columns:
        records = records.withColumn("items", F.lit(None).cast("array<struct<label:string,level:int,text:string>>"))
    rec = records.join(_first_lines(lines), ["doc_id", "asset_uri"], "left").withColumn("_p", F.coalesce("line_no", F.lit(1 << 30)))
    heads = rec.select("doc_id", "rec_idx", "_p", F.posexplode("items").alias("_i", "i")).where("i.label = 'section_header' and trim(i.text) <> ''")
    t = text.strip(F.col("i.text"))
    heading = F.coalesce(text.numbered_heading(t), F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce("i.level", F.lit(6)), F.lit(1)), F.lit(6))), F.lit(" "), t))
    heads = heads.select("doc_id", "rec_idx", "_p", "_i", text.text_signature(t).alias("_s"), heading.alias("_h"))
    known = with_fences(lines).where("not is_fence and not in_fence").select("doc_id", F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1).alias("h")).where("h <> ''").select("doc_id", text.text_signature(F.col("h")).alias("_s")).distinct()
    fresh = heads.join(known, ["doc_id", "_s"], "left_anti").withColumn("_t", F.row_number().over(Window.partitionBy("doc_id", "_s").orderBy("_p", "rec_idx", "_i"))).where("_t = 1")
    fresh = fresh.groupBy("doc_id", "rec_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_h"))), lambda x: x["_h"]).alias("_heads"))
    body = F.filter("items", lambda x: (x["label"] != "section_header") & (text.strip(x["text"]) != ""))
    own = F.when(F.size("items") > 0, F.flatten(F.transform(body, lambda x: quote(text.strip(x["text"]))))).otherwise(quote(F.col("text")))
    df = records.join(fresh, ["doc_id", "rec_idx"], "left")
    put = F.concat(F.flatten(F.transform(F.coalesce("_heads", F.array().cast("array<string>")), lambda h: F.array(F.lit(""), h))), F.array(F.lit(""), label), own)
    return _put(lines, df.select("doc_id", "rec_idx", "asset_uri", put.alias("put")), "rec_idx", title)


def inject_warnings(lines: DataFrame, coverage_: DataFrame, title: str = "## Unresolved Image Content") -> DataFrame:
    """Lines with a warning after the first image line of each qualifying picture without text, and those that no line shows under ``title``.

    ``coverage_``: doc_id, pic_idx, asset_uri, qualifying, coverage_status, and picture_file or ref where known.
    """
    open_ = coverage_.where(F.col("qualifying") & ~F.col("coverage_status").isin("structured_text", "ocr_text"))
    open_ = open_.join(_first_lines(lines).withColumnRenamed("line_no", "_at"), ["doc_id", "asset_uri"], "left")
    name = F.coalesce(*(F.col(c) for c in ("picture_file", "ref") if c in coverage_.columns), F.lit("picture"))
    warning = F.concat(F.lit("> **Review required:** no verified text of this picture ("), "coverage_status", F.lit("); look at the picture itself."))
    put = F.when(F.col("_at").isNull(), F.array(F.lit(""), F.concat(F.lit("### "), name), warning)).otherwise(F.array(F.lit(""), warning))
    return _put(lines, open_.select("doc_id", "pic_idx", "asset_uri", put.alias("put")), "pic_idx", title)


def child_items(pictures: DataFrame, items: DataFrame, furniture: DataFrame | None = None) -> DataFrame:
    """(doc_id, pic_idx, pos, ref, label, text, level): texts inside pictures; levels at most the picture's ceiling.

    Blank texts and page furniture, by label or by a signature in ``furniture`` (doc_id, signature), are left out.
    ``pictures``: doc_id, pic_idx, children, heading_ceiling.
    """
    c = pictures.select("doc_id", "pic_idx", "heading_ceiling", F.posexplode("children").alias("pos", "ref"))
    own = items.where("label not in ('page_header', 'page_footer')").withColumn("text", text.strip(F.col("text"))).where("text <> ''")
    if furniture is not None:
        own = own.withColumn("signature", text.text_signature(F.col("text"))).join(furniture, ["doc_id", "signature"], "left_anti")
    df = c.join(own, ["doc_id", "ref"])
    return df.select("doc_id", "pic_idx", "pos", "ref", "label", "text", F.when(F.col("level").isNotNull(), F.least("level", F.coalesce("heading_ceiling", "level"))).alias("level"))


def picture_findings(coverage_: DataFrame) -> DataFrame:
    """(doc_id, finding_id, category, status, message, blocks_llm_readiness, ref): qualifying pictures whose text is not structured.

    Text read by OCR is of low trust, so it needs review as well. Numbered vi-0001... per document in the order of pictures.
    """
    bad = coverage_.where(F.col("qualifying") & (F.col("coverage_status") != "structured_text"))
    category = F.when(F.col("coverage_status") == "ocr_text", "low_trust_picture_ocr").otherwise("unverified_picture_text")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("pic_idx"))
    return bad.select(
        "doc_id", F.format_string("vi-%04d", turn).alias("finding_id"), category.alias("category"), F.lit("review_required").alias("status"), F.concat(F.lit("picture text is "), "coverage_status").alias("message"), F.lit(True).alias("blocks_llm_readiness"), "ref"
    )


def source_refs(picture_ref: Column, context: Column, items: Column, asset_uri: Column) -> Column:
    """The picture, then its context and items, each once, in order; the asset where there is no reference."""
    refs = F.array_distinct(F.filter(F.concat(F.array(picture_ref), F.coalesce(context, F.array().cast("array<string>")), F.coalesce(items, F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    return F.when(F.size(refs) > 0, refs).otherwise(F.filter(F.array(asset_uri), lambda x: x.isNotNull()))
