"""Markdown lines: headings, fences, pipe tables and their repair.

Input of every operator: ``lines(doc_id, line_no, line)``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scans, text
from ..functions.similarity import ratio

TABLE_HEADERS = {
    ("Category", "Requirement"): "Backup & Recovery|Compliance|Performance|Reliability|Scalability|Security|Usability".split("|"),
    ("Component", "Specification"): "# of Virtual Machines (VMs)|Application Stack|Authentication|CPU Configuration|Database|Disk Size|Environment|Memory (RAM)|Operating System|Storage Type".split("|"),
}
SIMILAR, BOTTOM, TOP, EDGE = 0.95, 0.12, 0.85, 0.08


def to_lines(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, line_no, line) of each text; a null text has none."""
    return docs.select("doc_id", F.posexplode(F.split(F.col(column), "\n", -1)).alias("line_no", "line"))


def to_text(lines: DataFrame, name: str = "markdown") -> DataFrame:
    """Lines of each document joined again, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(name))


def with_fences(lines: DataFrame) -> DataFrame:
    """Adds is_fence and in_fence."""
    fence = F.col("line").rlike(r"^\s*```")
    return lines.withColumn("is_fence", fence).withColumn("in_fence", scans.inside_fence(fence, scans.ordered("doc_id", "line_no")))


def heading_levels(items: DataFrame) -> DataFrame:
    """(doc_id, signature, doc_level): most frequent level of each heading text, the smallest on a tie."""
    sig = text.text_signature(F.col("text"))
    return items.where(F.col("label").isin("section_header", "title") & F.col("level").isNotNull()).groupBy("doc_id", sig.alias("signature")).agg(F.mode("level", True).alias("doc_level"))


def furniture(items: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, signature) of page headers and footers, and of section headers near a page edge that occur twice or more.

    ``items``: doc_id, label, text, and page_no, top, bottom where known; ``pages``: doc_id, page_no, height.
    """
    sig = text.text_signature(F.col("text"))
    own = items.where(F.col("label").isin("page_header", "page_footer")).select("doc_id", sig.alias("signature"))
    if pages is not None:
        near = items.where("label = 'section_header'").join(pages, ["doc_id", "page_no"])
        near = near.where((F.col("height") - F.col("top") <= EDGE * F.col("height")) | (F.col("bottom") <= EDGE * F.col("height")))
        own = own.unionByName(near.groupBy("doc_id", sig.alias("signature")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n"))
    return own.where("signature <> ''").distinct()


def clean_headings(lines: DataFrame, levels: DataFrame | None = None, furniture_: DataFrame | None = None, code_starts: DataFrame | None = None) -> DataFrame:
    """Heading lines outside fences repaired; a fused heading gives several lines (joined by a line feed in ``line``).

    Order of the rules: empty, page furniture, start of a source-code item (inside fences as well), a title beginning
    with "of", fused numbers, numbered title, field label, sentence, the document's own level, the hashes (6 at most).
    """
    h = r"(?d)^(\#{1,10})\s+(.*)"  # (?d): only a line feed ends a line, so that no title is cut at another mark
    df = with_fences(lines).withColumn("_is", F.col("line").rlike(h))
    df = df.withColumn("_t", text.strip(F.regexp_extract("line", h, 2))).withColumn("_sig", F.when(F.col("_is"), text.text_signature(F.col("_t"))))
    if levels is not None:
        df = df.join(levels.withColumnRenamed("signature", "_s").withColumnRenamed("doc_id", "_i"), (F.col("doc_id") == F.col("_i")) & (F.col("_sig") == F.col("_s")), "left").drop("_s", "_i")
    else:
        df = df.withColumn("doc_level", F.lit(None).cast("int"))
    if furniture_ is not None:
        df = df.join(furniture_.select(F.col("doc_id").alias("_i"), F.col("signature").alias("_s"), F.lit(True).alias("_furniture")), (F.col("doc_id") == F.col("_i")) & (F.col("_sig") == F.col("_s")), "left").drop("_s", "_i")
    else:
        df = df.withColumn("_furniture", F.lit(None).cast("boolean"))
    if code_starts is not None:  # one short list of starts for a document
        starts = code_starts.groupBy(F.col("doc_id").alias("_i")).agg(F.collect_set(text.text_signature(F.col("text"))).alias("_starts"))
        df = df.join(starts, F.col("doc_id") == F.col("_i"), "left").drop("_i")
        df = df.withColumn("_code", (F.length("_sig") >= 12) & F.exists(F.coalesce("_starts", F.array()), lambda s: s.startswith(F.col("_sig"))))
    else:
        df = df.withColumn("_code", F.lit(False))
    t = F.regexp_replace("_t", r"^(\d+(?:[.]\d+)+)([A-Z])", "$1 $2")
    parts = F.split(t, r"\s+(?=\d+(?:[.]\d+)+\s+[A-Z])", -1)
    fused = (F.size(parts) > 1) & F.get(parts, F.lit(0)).rlike(r"^\d+(?:[.]\d+)+\s+")
    level = F.coalesce(F.col("doc_level"), F.least(F.length(F.regexp_extract("line", h, 1)), F.lit(text.MAX_LEVEL)))
    cleaned = (
        F.when(F.col("_code"), F.concat(F.lit("\\# "), "_t"))
        .when(F.col("in_fence") | F.col("is_fence"), F.col("line"))
        .when(F.col("_t") == "", F.lit(""))
        .when(F.col("_furniture"), F.lit(""))
        .when(F.lower("_t").startswith("of "), F.concat(F.lit("\\# "), "_t"))
        .when(fused, F.array_join(F.transform(parts, lambda p: F.coalesce(text.numbered_heading(text.strip(p)), p)), "\n"))
        .otherwise(
            F.coalesce(
                text.numbered_heading(t),
                F.when(text.is_false_label_heading(t), text.bare_label(t)),
                F.when(text.is_false_sentence_heading(t), text.normalize_sentence(t)),
                F.concat(F.repeat(F.lit("#"), level), F.lit(" "), t),
            )
        )
    )
    return df.withColumn("line", F.when(F.col("_is"), cleaned).otherwise(F.col("line"))).select("doc_id", "line_no", "line")


def code_starts(items: DataFrame) -> DataFrame:
    """(doc_id, text): first line of each source-code item, for clean_headings."""
    return items.where("label = 'code' and trim(text) <> ''").select("doc_id", F.regexp_extract("text", r"^\s*([^\n]*)", 1).alias("text"))


def clean_markdown(docs: DataFrame, items: DataFrame | None = None, pages: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown): Markdown of a converter (doc_id, text) repaired: entities, headings, continued tables and wrapped headers, tables without borders.

    ``items`` (as for furniture, with level) and ``pages`` tell heading levels, page furniture and source code; ``tables``
    (doc_id, table_idx, page, top, bottom, page_height) where tables stand: a document whose pipe tables are not as many as
    these has its tables left as they are.
    """
    lines = to_lines(docs.select("doc_id", text.normalize_entities(F.col("text")).alias("text")))
    if items is not None:
        done = clean_headings(lines, heading_levels(items), furniture(items, pages), code_starts(items))
    else:
        done = clean_headings(lines)
    lines = to_lines(to_text(done, "text"))  # a fused heading has become several lines
    found = table_blocks(lines)
    if tables is not None:
        n = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).join(tables.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_m")), "doc_id").where("_n = _m").select("doc_id")
        place = tables.select("doc_id", "table_idx", "page", "top", "bottom", "page_height")
        known = merge_continued_tables(found.join(n, "doc_id", "left_semi").join(place, ["doc_id", "table_idx"]))
        rest = found.join(known.select("doc_id", "table_idx"), ["doc_id", "table_idx"], "left_anti").join(n, "doc_id", "left_semi").select("doc_id", "first_line", "last_line")
        kept = known.select("doc_id", "first_line", "last_line", "header", "rows", "merged").unionByName(found.join(n, "doc_id", "left_anti").select("doc_id", "first_line", "last_line", "header", "rows", F.lit(False).alias("merged")))
    else:
        rest, kept = None, found.select("doc_id", "first_line", "last_line", "header", "rows", F.lit(False).alias("merged"))
    kept = repair_header_fragments(kept).where(F.col("merged") | (F.size("repairs") > 0))
    spans = kept.select("doc_id", "first_line", "last_line", render_table(F.col("header"), F.col("rows")).alias("line"))
    if rest is not None:
        spans = spans.unionByName(rest.withColumn("line", F.lit(None).cast("string")))
    # spans of a document don't overlap: the last one that begins at or before a line tells whether it lies inside
    marks = lines.select("doc_id", "line_no", "line").join(spans.select("doc_id", F.col("first_line").alias("line_no"), F.col("last_line").alias("_l"), F.lit(True).alias("_s"), F.col("line").alias("_new")), ["doc_id", "line_no"], "left")
    last = F.last("_l", ignorenulls=True).over(scans.ordered("doc_id", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marks = marks.withColumn("_in", F.coalesce(F.col("line_no") <= last, F.lit(False)))
    out = marks.where((~F.col("_in")) | F.col("_new").isNotNull()).select("doc_id", "line_no", F.when(F.col("_in"), F.col("_new")).otherwise(F.col("line")).alias("line"))
    return borderless_tables(to_text(out))


def table_blocks(lines: DataFrame) -> DataFrame:
    """Pipe tables outside fences: one row per table with first and last line, header and rows as arrays of cells.

    A table is a run of lines that start with a pipe, whose second is a separator; rows of another width are dropped.
    """
    piped = with_fences(lines).where(~F.col("in_fence") & ~F.col("is_fence") & F.col("line").rlike(r"^\s*\|"))
    w = scans.ordered("doc_id", "line_no")
    piped = piped.withColumn("_run", F.col("line_no") - F.row_number().over(w)).withColumn("cells", text.parse_row(F.col("line")))
    run = piped.groupBy("doc_id", "_run").agg(F.array_sort(F.collect_list(F.struct("line_no", "cells"))).alias("x"))
    run = run.where((F.size("x") >= 2)).where(text.is_separator(F.col("x")[1]["cells"]))
    header = F.col("x")[0]["cells"]
    rows = F.filter(F.transform(F.slice("x", 3, 1 << 30), lambda x: x["cells"]), lambda r: F.size(r) == F.size(header))
    return run.select("doc_id", F.col("x")[0]["line_no"].alias("first_line"), F.element_at("x", -1)["line_no"].alias("last_line"), header.alias("header"), rows.alias("rows")).withColumn(
        "table_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")) - 1
    )


def render_table(header, rows):
    """Markdown of a table's arrays, one Column."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: text.escape_cell(x)), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(header, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(header), rule), F.transform(rows, line)), "\n")


def merge_continued_tables(tables: DataFrame) -> DataFrame:
    """Tables that a page break cut, joined with the one before; non-overlapping pairs, first come first served.

    ``tables``: doc_id, table_idx, header, rows, and page, top, bottom, page_height, next_page_height. Two tables belong
    together if their widths agree, their headers are at least 0.95 alike, the second is one or two pages on, and they
    touch the bottom and the top of their pages. Where the first row of the second carries on the last of the first, the
    cells of both are merged. Gives the kept tables with ``merged``.
    """
    w = scans.ordered("doc_id", "table_idx")
    nxt = F.lead(F.struct("header", "rows", "page", "top", "page_height")).over(w)
    df = tables.withColumn("_n", nxt)
    head = F.array_join("header", " ")
    other = F.array_join("_n.header", " ")
    # the ratio can't reach the limit where the lengths differ too much, so Python sees few pairs
    short = 2 * F.least(F.length(head), F.length(other)) >= SIMILAR * (F.length(head) + F.length(other))
    near = (F.size("header") == F.size("_n.header")) & (F.col("_n.page") - F.col("page")).between(1, 2) & short
    near = near & (F.col("bottom") <= BOTTOM * F.col("page_height")) & (F.col("_n.top") >= TOP * F.col("_n.page_height"))
    df = df.withColumn("_near", F.coalesce(near, F.lit(False)))
    some = df.where(F.col("_near") & (head != other)).withColumn("_flag", ratio(head, other) >= SIMILAR).select("doc_id", "table_idx", "_flag")
    df = df.join(some, ["doc_id", "table_idx"], "left").withColumn("_flag", F.col("_near") & F.coalesce("_flag", head == other))
    df = scans.odd_in_run(df, "_flag", ["doc_id"], ["table_idx"])
    taken = F.coalesce(F.lag("fires").over(w), F.lit(False))
    left, right = F.element_at("rows", -1), F.get(F.col("_n.rows"), F.lit(0))
    split = (F.size("rows") > 0) & (F.size("_n.rows") > 0) & text.rows_continue(left, right)
    joined = F.zip_with(left, right, lambda a, b: text.merge_cells(a, b))
    both = F.when(split, F.concat(F.slice("rows", F.lit(1), F.size("rows") - 1), F.array(joined), F.slice("_n.rows", 2, 1 << 30))).otherwise(F.concat("rows", "_n.rows"))
    df = df.withColumn("_taken", taken).where("not _taken")
    return df.withColumn("rows", F.when(F.col("fires"), both).otherwise(F.col("rows"))).withColumn("merged", F.col("fires")).drop("_n", "_near", "_flag", "fires", "_taken")


def repair_header_fragments(tables: DataFrame) -> DataFrame:
    """Header cells like "Threshol d" joined; ``repairs`` lists (before, after)."""
    fixed = F.transform("header", text.join_header_fragment)
    pairs = F.filter(F.zip_with("header", fixed, lambda a, b: F.struct(a.alias("before"), b.alias("after"))), lambda p: text.strip(p["before"]) != p["after"])
    return tables.withColumn("repairs", pairs).withColumn("header", fixed)


def borderless_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, markdown) with two-column tables of known headers, written one cell a line, as pipe tables.

    The scan looks ahead by an unknown number of lines, so each text is read by one Python call; no group is built.
    """

    def fix(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "markdown": [None if t is None else _borderless(t) for t in b["markdown"]]})

    return docs.select("doc_id", "markdown").mapInPandas(fix, docs.select("doc_id", "markdown").schema)


def _borderless(markdown: str) -> str:
    lines = markdown.split("\n")
    i, out = 0, []
    while i < len(lines):
        first = lines[i].strip()
        j = next((k for k in range(i + 1, len(lines)) if lines[k].strip()), None)
        labels = TABLE_HEADERS.get((first, lines[j].strip())) if j is not None else None
        if labels is None:
            out.append(lines[i])
            i += 1
            continue
        cells: list[str] = []
        k = j + 1
        while k < len(lines):
            s = lines[k].strip()
            if s.startswith(("![", "|")) or (s.startswith("#") and s.lstrip("#").startswith(" ")):
                break
            if s:
                s = s[1:] if s.startswith("\\#") else s
                fused = next((x for x in sorted(labels, key=len, reverse=True) if s.startswith(x + " ")), None)
                cells += [fused, s[len(fused) :].strip()] if fused else [s]
            k += 1
        if len(cells) < 4 or len(cells) % 2:
            out.append(lines[i])
            i += 1
            continue
        esc = [c.replace("|", "\\|") for c in cells]
        if out and out[-1].strip():
            out.append("")
        out += [f"| {first} | {lines[j].strip()} |", " --- ".join("|||"), *(f"| {a} | {b} |" for a, b in zip(esc[::2], esc[1::2])), ""]
        i = k
    return "\n".join(out).rstrip() + "\n"
