"""Table integrity: snapshots of tables, the rules on neighbouring fragments, findings, and what they mean for chunks.

``cells(doc_id, table_idx, ref, text, start_row, end_row, start_col, end_col, column_header, row_header, left, right)``:
one row per cell; end offsets are exclusive. ``tables(doc_id, table_idx, ref, page, top, bottom, num_rows, num_cols)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scans, text
from ..functions.similarity import ratio

STATUSES = ["verified", "preserved", "repaired_high_confidence", "review_required"]
BOTTOM, TOP, SIMILAR = 0.12, 0.85, 0.95
EDGE_SHARE, EDGE_LEAST = 0.035, 12.0


def status_rank(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*(F.lit(s) for s in STATUSES)), c), F.lit(0))


def worst_status(c: Column) -> Column:
    """Aggregate: the status that weighs most."""
    return F.max_by(c, status_rank(c))


def grid(cells: DataFrame, expand_spans: bool = True) -> DataFrame:
    """(doc_id, table_idx, row, values, header_flags): cell texts by row; of cells that overlap the last one stays."""
    row = F.explode(F.sequence(F.col("start_row"), F.col("end_row") - 1)) if expand_spans else F.col("start_row")
    df = cells.withColumn("_ord", F.coalesce(F.col("cell_ord"), F.lit(0)) if "cell_ord" in cells.columns else F.col("start_row") * 100000 + F.col("start_col"))
    df = df.withColumn("row", row)
    df = df.withColumn("col", F.explode(F.sequence(F.col("start_col"), F.col("end_col") - 1)) if expand_spans else F.col("start_col"))
    one = df.groupBy("doc_id", "table_idx", "row", "col").agg(F.max_by("text", "_ord").alias("text"), F.max_by("column_header", "_ord").alias("flag"))
    ordered = F.array_sort(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("flag", F.lit(False)).alias("flag"))))
    rows = one.groupBy("doc_id", "table_idx", "row").agg(ordered.alias("x"))
    return rows.select("doc_id", "table_idx", "row", F.transform("x", lambda x: x["text"]).alias("values"), F.exists("x", lambda x: x["flag"]).alias("is_header"))


def is_credible(header: Column) -> Column:
    """A header without blanks, not all numbers, whose signatures are unique and not empty."""
    sigs = F.transform(header, text.text_signature)
    return (
        (F.size(header) > 0)
        & F.forall(header, lambda x: text.strip(x) != "")
        & ~F.forall(header, text.is_numeric_label)
        & F.forall(sigs, lambda s: s != "")
        & (F.size(F.array_distinct(sigs)) == F.size(header))
    )


def column_edges(cells: DataFrame) -> DataFrame:
    """(doc_id, table_idx, edges): leftmost and rightmost x of each column over cells of one column."""
    single = cells.where((F.col("end_col") - F.col("start_col") == 1) & F.col("left").isNotNull() & F.col("right").isNotNull())
    per = single.groupBy("doc_id", "table_idx", F.col("start_col").alias("col")).agg(F.min("left").alias("l"), F.max("right").alias("r"))
    return per.groupBy("doc_id", "table_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "l", "r"))), lambda x: F.struct(x["l"].alias("l"), x["r"].alias("r"))).alias("edges"))


def snapshots(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """``tables`` with rows, header (null if not credible) and column edges: the state all rules look at.

    The header is the last of the leading rows that carry a column-header flag.
    """
    g = grid(cells)
    w = Window.partitionBy("doc_id", "table_idx").orderBy("row")
    g = g.withColumn("_lead", F.min(F.col("is_header").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    per = g.groupBy("doc_id", "table_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", "values"))), lambda x: x["values"]).alias("grid"),
        F.max_by(F.when(F.col("_lead"), F.col("values")), F.when(F.col("_lead"), F.col("row"))).alias("header"),
        F.coalesce(F.max(F.when(F.col("_lead"), F.col("row") + 1)), F.lit(0)).alias("header_rows"),
    )
    df = tables.join(per, ["doc_id", "table_idx"], "left").join(column_edges(cells), ["doc_id", "table_idx"], "left")
    return df.withColumn("credible", F.coalesce(is_credible(F.col("header")), F.lit(False)))


def compatible_columns(a: Column, b: Column, cols_a: Column, cols_b: Column, page_width: Column) -> Column:
    """Same positive number of columns, edges within tolerance; missing or unequal lists of edges pass."""
    limit = F.greatest(page_width * EDGE_SHARE, F.lit(EDGE_LEAST))
    near = F.forall(F.zip_with(a, b, lambda x, y: (F.abs(x["l"] - y["l"]) <= limit) & (F.abs(x["r"] - y["r"]) <= limit)), lambda x: x)
    unknown = a.isNull() | b.isNull() | (F.size(a) != F.size(b))
    return (cols_a == cols_b) & (cols_a > 0) & F.coalesce(unknown | near, F.lit(True))


def _finding(category: str, status: str, order: int, tables: Column) -> Column:
    return F.struct(F.lit(order).alias("rule"), F.lit(category).alias("category"), F.lit(status).alias("status"), tables.alias("tables"), F.lit(status == "review_required").alias("blocks_llm_readiness"))


def with_adjacency(snaps: DataFrame, body: DataFrame) -> DataFrame:
    """Adds adjacent_next: whether the next table of the document follows in the body with nothing but page headers and footers between.

    ``body``: doc_id, ref, pos, label of the body's own children; tables that are not among them are adjacent to nothing.
    """
    stops = (~F.coalesce(F.col("label").isin("page_header", "page_footer"), F.lit(False))).cast("int")
    w = scans.ordered("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = body.withColumn("_at", F.sum(stops).over(w)).groupBy("doc_id", "ref").agg(F.min("_at").alias("_at"))
    df = snaps.join(at, ["doc_id", "ref"], "left")
    return df.withColumn("adjacent_next", F.coalesce(F.lead("_at").over(scans.ordered("doc_id", "table_idx")) - F.col("_at") == 1, F.lit(False))).drop("_at")


def pairs(snaps: DataFrame) -> DataFrame:
    """Each snapshot with the next one of its document as ``n``; ``flow``: the two meet at a page break, ``fits``: so do their columns.

    Columns adjacent (default true: nothing but page furniture between them), page_height and page_width may be there.
    """
    w = scans.ordered("doc_id", "table_idx")
    df = snaps.withColumn("n", F.lead(F.struct(*snaps.columns)).over(w))
    adjacent = F.coalesce(F.col("adjacent_next"), F.lit(True)) if "adjacent_next" in snaps.columns else F.lit(True)
    flow = (F.col("n.page") - F.col("page") == 1) & (F.col("bottom") <= BOTTOM * F.col("page_height")) & (F.col("n.top") >= TOP * F.col("n.page_height")) & adjacent
    fits = compatible_columns(F.col("edges"), F.col("n.edges"), F.col("num_cols"), F.col("n.num_cols"), F.col("page_width"))
    df = df.withColumns({"flow": F.coalesce(flow, F.lit(False)), "fits": F.coalesce(fits, F.lit(False))})
    joined = F.col("flow") & F.col("fits") & F.col("credible")
    sigs = lambda h: F.array_join(F.transform(h, text.text_signature), "|")
    head, other = sigs(F.col("header")), sigs(F.col("n.header"))
    short, long = F.least(F.length(head), F.length(other)), F.greatest(F.length(head), F.length(other))
    near = joined & F.col("n.credible") & (head != other) & (2 * short >= SIMILAR * (short + long))
    same = (F.size("header") == F.size("n.header")) & ((head == other) | (ratio(F.when(near, head), other) >= SIMILAR))
    df = df.withColumns(
        {
            "inherits": joined & ~F.coalesce(F.col("n.credible"), F.lit(True)),
            "repeats": F.coalesce(joined & F.col("n.credible") & same, F.lit(False)),
        }
    )
    # a header that isn't credible counts as rows
    head_rows = F.when(F.col("n.credible"), F.col("n.header_rows")).otherwise(0)
    left, right = F.get(F.col("grid"), F.size("grid") - 1), F.get(F.col("n.grid"), head_rows)
    # a fragment without a body, or of one row under an inherited header, has nothing to merge or would lose its only row
    long_enough = (F.size("grid") > F.col("header_rows")) & (F.size("n.grid") > head_rows) & (F.size(left) == F.size(right))
    split = (F.col("inherits") | F.col("repeats")) & long_enough & ((F.size("n.grid") >= 2) | F.col("n.credible")) & text.rows_continue(left, right)
    df = df.withColumn("splits", F.coalesce(split, F.lit(False)))
    # a row that is cut at both ends of its fragment may have left for the fragment before: the second cut stays as it is
    gone = F.lag("splits").over(w) & F.col("credible") & (F.size("grid") - F.col("header_rows") == 1)
    df = df.withColumn("unmerged", F.col("splits") & F.coalesce(gone, F.lit(False)))
    df = df.withColumn("splits", F.col("splits") & ~F.col("unmerged"))
    merged = F.zip_with(left, right, lambda x, y: text.merge_cells(x, y, markdown=False))
    return df.withColumn("merged", F.when(F.col("splits"), merged))


def _fixed_header(header: Column) -> Column:
    return F.transform(header, text.join_header_fragment)


def analyze(snaps: DataFrame) -> DataFrame:
    """Findings of all rules, numbered si-0001... per document in the order of rules and tables."""
    df = pairs(snaps).withColumn("_got", F.coalesce(F.lag("inherits").over(scans.ordered("doc_id", "table_idx")), F.lit(False)))
    one, both = F.array("table_idx"), F.array("table_idx", "n.table_idx")
    only_header = F.size("grid") <= F.col("header_rows")
    inherits, credible = F.col("inherits"), F.col("credible")
    rules = [
        (credible & (_fixed_header(F.col("header")) != F.transform("header", text.strip)), "wrapped_header_fragments", "repaired_high_confidence", 1, one),
        (F.col("flow") & ~F.col("fits"), "ambiguous_table_boundary", "review_required", 2, both),
        (F.col("repeats"), "repeated_continuation_header", "verified", 3, both),
        (inherits & only_header, "header_only_fragment_continuation", "repaired_high_confidence", 4, both),
        (inherits & ~only_header, "missing_continuation_header", "repaired_high_confidence", 5, both),
        (F.col("splits"), "explicit_row_split", "repaired_high_confidence", 6, both),
        (F.col("unmerged"), "explicit_row_split", "review_required", 6, both),
        (~credible & ~F.col("_got"), "synthetic_numeric_headers", "review_required", 7, one),
    ]
    found = df.select("doc_id", "table_idx", F.explode(F.array_compact(F.array(*(F.when(test, _finding(*rule)) for test, *rule in rules)))).alias("f"))
    found = found.select("doc_id", "f.rule", "table_idx", "f.category", "f.status", "f.tables", "f.blocks_llm_readiness")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("rule", "table_idx"))
    return found.withColumn("finding_id", F.format_string("si-%04d", turn))


def repaired_grids(snaps: DataFrame) -> DataFrame:
    """(doc_id, table_idx, rows, inherited): tables with all repairs that analyze() reports; the input stays as it is.

    Wrapped header cells are joined, a fragment inherits the header of the one before, and a row that the page break cut is
    merged into the last row of the first fragment and leaves the second.
    """
    w = scans.ordered("doc_id", "table_idx")
    df = pairs(snaps).withColumn("_prev", F.lag(F.struct("inherits", "splits", "merged", "header")).over(w))
    inherits, cut = (F.coalesce(F.col(c), F.lit(False)) for c in ("_prev.inherits", "_prev.splits"))
    head_rows = F.when(F.col("credible"), F.col("header_rows")).otherwise(0)
    n = F.size("grid")

    def row(v: Column, i: Column) -> Column:
        return F.when(F.col("credible") & (i == head_rows - 1), _fixed_header(v)).when(F.col("splits") & (i == n - 1), F.col("merged")).otherwise(v)

    rows = F.transform("grid", row)
    rows = F.when(cut, F.concat(F.slice(rows, F.lit(1), head_rows), F.slice(rows, head_rows + 2, F.greatest(n - head_rows - 1, F.lit(0))))).otherwise(rows)
    rows = F.when(inherits, F.concat(F.array("_prev.header"), rows)).otherwise(rows)
    return df.select("doc_id", "table_idx", rows.alias("rows"), inherits.alias("inherited"))


def report(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per document: counts by status, blocking findings and readiness; a document without findings is ready."""
    counts = findings.groupBy("doc_id").agg(
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES[1:]), F.count_if("blocks_llm_readiness").alias("n_blocking")
    )
    df = documents.select("doc_id").distinct().join(counts, "doc_id", "left").na.fill(0)
    return df.withColumn("readiness", F.when((F.col("n_review_required") > 0) | (F.col("n_blocking") > 0), "review_required").otherwise("ready"))


def evidence(findings: DataFrame) -> DataFrame:
    """(doc_id, finding_id, category, status, evidence_type, folder, table_number, file): table pictures that back a repair or a question.

    One row per fragment, named as a converter exports them; tables count from 1. Findings that neither repair nor ask have none.
    """
    own = findings.where("status in ('repaired_high_confidence', 'review_required')").select("doc_id", "finding_id", "category", "status", F.posexplode("tables").alias("_i", "t"))
    number = (F.col("t") + 1).cast("int")
    return own.select("doc_id", "finding_id", "category", "status", F.lit("semantic_integrity_table_fragments").alias("evidence_type"), F.col("finding_id").alias("folder"), number.alias("table_number"), F.format_string("table-fragment-%04d.png", number).alias("file"))


def annotate(chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_idx, refs, text, ...) with the findings on their refs: ids, worst status, and a warning before the text of a chunk that needs review.

    ``findings``: doc_id, finding_id, status, ref, warning.
    """
    key = ["doc_id", "chunk_idx"]
    hit = chunks.select(*key, F.explode("refs").alias("ref")).join(findings, ["doc_id", "ref"])
    per = hit.groupBy(*key).agg(
        F.array_sort(F.collect_set("finding_id")).alias("integrity_finding_ids"),
        worst_status(F.col("status")).alias("integrity_status"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "review_required", F.col("warning")))).alias("_w"),
    )
    df = chunks.join(per, key, "left")
    warned = F.when(F.size("_w") > 0, F.concat(F.lit("[Review required: "), F.array_join("_w", "; "), F.lit("]\n"), "text"))
    return df.withColumns(
        {
            "text": F.coalesce(warned, F.col("text")),
            "integrity_status": F.coalesce("integrity_status", F.lit("verified")),
            "integrity_finding_ids": F.coalesce("integrity_finding_ids", F.array().cast("array<string>")),
        }
    ).drop("_w")
