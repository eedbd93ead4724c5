"""Chunks: token-bounded pieces of blocks, tables, pictures and warnings, and the review queue.

Tokens are counted by ``counter``, a Column -> Column function; whitespace words by default, which adds up over units and
so needs no search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scans, text

MAX_TOKENS = 1200
Counter = Callable[[Column], Column]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row: later expressions read them, where the optimizer would else write them out again inside lambdas."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def split_words(df: DataFrame, column: str, prefix: Column | None = None, limit: int = MAX_TOKENS) -> DataFrame:
    """Lossless greedy split of ``column`` at white space: adds segment_index, segment_count, segment and token_count.

    A prefix counts in every segment; one that fills the limit alone loses its leading lines until it fits. Texts within
    the limit, nearly all, are never taken apart; longer ones are once, and their segments are slices of that, so the cost
    is linear. A null or blank text gives no row.
    """
    df = df.withColumn("_n", text.word_count(F.col(column))).where("_n > 0")
    p = F.lit("") if prefix is None else F.coalesce(prefix, F.lit(""))
    lines = F.split(p, "\n")
    tails = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.array_join(F.slice(lines, i, 1 << 30), "\n"))
    fitting = F.get(F.filter(F.concat(tails, F.array(F.lit(""))), lambda t: text.word_count(t) < limit), F.lit(0))
    room = F.lit(limit) - (text.word_count(fitting) if prefix is not None else 0)
    df = once(df, _cap=room, _u=F.when(F.col("_n") > room, F.regexp_extract_all(F.col(column), F.lit(r"\S+\s*"), F.lit(0))))
    df = df.withColumn("segment_count", F.ceil(F.col("_n") / F.col("_cap")).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("segment_count") - 1), lambda i: text.strip(F.array_join(F.slice("_u", i * F.col("_cap") + 1, F.col("_cap")), "")))
    segments = F.when(F.col("_u").isNull(), F.array(text.strip(F.col(column)))).otherwise(cut)
    df = df.select("*", F.posexplode(segments).alias("segment_index", "segment"))
    words = F.when(F.col("_u").isNull(), F.col("_n")).otherwise(text.word_count(F.col("segment")))
    return df.withColumn("token_count", words + F.lit(limit) - F.col("_cap")).drop("_n", "_cap", "_u")


def greedy_starts(units: Column, limit: Column) -> Column:
    """First places (from 1) of the pieces into which units are added in order while a piece has at most ``limit`` words.

    A unit is struct(k words, stop, gap): after one that neither ends a sentence (stop) nor in white space (gap), the next
    is joined without a space, which makes one word of two. The fold carries counts only, no text.
    """
    start = F.struct(F.array(F.lit(1)).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(True).alias("loose"))

    def add(s: Column, u: Column) -> Column:
        n = s["n"] + u["k"] - (~s["loose"]).cast("int")
        full = (s["i"] > 0) & (n > limit)
        at = F.when(full, F.array_append(s["at"], s["i"] + 1)).otherwise(s["at"])
        return F.struct(at.alias("at"), F.when(full, u["k"]).otherwise(n).alias("n"), (s["i"] + 1).alias("i"), (u["stop"] | u["gap"]).alias("loose"))

    return F.aggregate(units, start, add, lambda s: s["at"])


def sliced(units: Column, at: Column, put: Callable[[Column], Column]) -> Column:
    """The pieces that begin at the places ``at``, each as ``put`` makes it of its units."""
    return F.transform(at, lambda a, j: put(F.slice(units, a, F.coalesce(F.get(at, j + 1), F.size(units) + 1) - a)))


def pack_sentences(df: DataFrame, column: str, limit: int = MAX_TOKENS, prefix: Column | None = None) -> DataFrame:
    """Greedy packing of sentences and paragraphs: adds piece_index, piece and token_count.

    A text within the limit is one piece. Else it is cut after . ! ? and at blank lines (at words if that gives one
    unit), and units are added while the limit holds; units after one without such an end are joined without a space. A
    single longer unit stays whole. Units are cut once, a fold over their word counts finds where pieces begin, and pieces
    are slices, so the cost is linear.
    """
    words_before = F.lit(0) if prefix is None else text.word_count(F.coalesce(prefix, F.lit("")))
    t = F.col(column)
    df = once(df.where(t.isNotNull() & (text.strip(t) != "")), _room=F.lit(limit) - words_before, _n=text.word_count(t))
    sentences = F.filter(F.split(t, r"\n{2,}|(?<=[?!.])\s+", -1), lambda x: x != "")
    df = once(df, _x=F.when(F.col("_n") > F.col("_room"), sentences))
    units = F.when(F.size("_x") == 1, F.regexp_extract_all(t, F.lit(r"\S+\s*"), F.lit(0))).otherwise(F.col("_x"))
    df = once(df, _u=F.transform(units, lambda u: F.struct(u.alias("u"), text.word_count(u).alias("k"), u.rlike(r"[.!?]\s*$").alias("stop"), u.rlike(r"\s$").alias("gap"))))
    df = once(df, _at=greedy_starts(F.col("_u"), F.col("_room")))
    joined = sliced(F.col("_u"), F.col("_at"), lambda own: text.strip(F.array_join(F.transform(own, lambda u: F.concat(u["u"], F.when(u["stop"], " ").otherwise(""))), "")))
    out = df.select("*", F.posexplode(F.when(F.col("_u").isNull(), F.array(t)).otherwise(joined)).alias("piece_index", "piece"))
    words = F.when(F.col("_u").isNull(), F.col("_n")).otherwise(text.word_count(F.col("piece")))
    return out.withColumn("token_count", words + F.lit(limit) - F.col("_room")).drop("_room", "_n", "_x", "_u", "_at")


def pair_labels(blocks: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Text blocks that end in = or : joined with the next block of the same section; the next block goes.

    The pair keeps the refs and pages of the first. Blocks: doc_id, ord, text, block_type, section_path.
    """
    order = order or ["ord"]
    w = scans.ordered("doc_id", order)
    textual = F.col("block_type").isin("paragraph", "list_item")
    nxt = F.lead(F.struct("text", "section_path", textual.alias("t"))).over(w)
    df = blocks.withColumn("_n", nxt)
    df = df.withColumn("_flag", F.coalesce(textual & text.needs_value(F.col("text")) & F.col("_n.t") & (F.col("_n.section_path") == F.col("section_path")), F.lit(False)))
    df = scans.odd_in_run(df, "_flag", ["doc_id"], order)
    df = df.withColumn("_gone", F.coalesce(F.lag("fires").over(w), F.lit(False))).where("not _gone")
    joined = F.concat(text.strip(F.col("text")), F.lit(" "), text.strip(F.col("_n.text")))
    return df.withColumn("text", F.when(F.col("fires"), joined).otherwise(F.col("text"))).withColumn("paired", F.col("fires")).drop("_n", "_flag", "fires", "_gone")


def row_text(headers: Column, row: Column) -> Column:
    """``H = v; ...`` of a table row; a blank header is Column n; blank values go."""
    named = F.transform(row, lambda v, i: F.when(text.strip(v) != "", F.concat(F.coalesce(F.nullif(text.strip(F.get(headers, i)), F.lit("")), F.concat(F.lit("Column "), (i + 1).cast("string"))), F.lit(" = "), text.strip(v))))
    return F.array_join(F.filter(named, lambda x: x.isNotNull()), "; ")


def table_chunks(tables: DataFrame) -> DataFrame:
    """One chunk per table row (row_index, chunk); a table of headers alone gives one chunk of them."""
    rows = F.when(F.size("rows") > 0, F.transform("rows", lambda r: row_text(F.col("headers"), r))).otherwise(F.array(F.array_join("headers", "; ")))
    return tables.select("*", F.posexplode(rows).alias("row_index", "chunk")).where("chunk <> ''")


def _whole(u: Column) -> Column:
    """A unit that no other is glued to."""
    return F.struct(u.alias("u"), text.word_count(u).alias("k"), F.lit(True).alias("stop"), F.lit(True).alias("gap"))


def code_chunks(blocks: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """Code blocks cut at line ends: adds piece_index, piece, token_count. A longer line stays whole."""
    df = once(blocks, _u=F.transform(F.split("text", "\n", -1), _whole))
    df = once(df, _at=greedy_starts(F.col("_u"), F.lit(limit)))
    pieces = sliced(F.col("_u"), F.col("_at"), lambda own: F.array_join(F.transform(own, lambda u: u["u"]), "\n"))
    return df.select("*", F.posexplode(pieces).alias("piece_index", "piece")).withColumn("token_count", text.word_count(F.col("piece"))).drop("_u", "_at")


def clean_chunks(blocks: DataFrame, supplements: DataFrame | None = None, limit: int = MAX_TOKENS) -> DataFrame:
    """The clean feed: verified text, tables and code as chunks, then verified supplements, numbered per document.

    Gives doc_id, chunk_idx, content_type, section_path, block_ids, text, token_count, over_limit. Headings and pictures
    speak through section paths; blocks that await review are left out.
    """
    ok = blocks.where("integrity_status in ('verified', 'ai_verified') and block_type not in ('heading', 'picture')")
    prefix = F.when(F.size("section_path") > 0, F.concat(F.array_join("section_path", " > "), F.lit("\n"))).otherwise("")
    base = ["doc_id", "ord", "section_path", "block_id"]
    textual = pair_labels(ok.where("block_type in ('paragraph', 'list_item')"))
    parts = pack_sentences(textual, "text", limit, prefix).select(*base, F.lit("text").alias("content_type"), F.col("piece_index").alias("_i"), F.concat(prefix, "piece").alias("text"))
    code = code_chunks(ok.where("block_type = 'code'"), limit).select(*base, F.lit("code").alias("content_type"), F.col("piece_index").alias("_i"), F.concat(prefix, "piece").alias("text"))
    out = parts.unionByName(code)
    if "rows" in blocks.columns:
        rows = table_chunks(ok.where("block_type = 'table'"))
        out = out.unionByName(rows.select(*base, F.lit("table_row").alias("content_type"), F.col("row_index").alias("_i"), F.concat(prefix, "chunk").alias("text")))
    if supplements is not None:
        out = out.unionByName(
            supplements.select("doc_id", F.lit((1 << 31) - 1).alias("ord"), F.array().cast("array<string>").alias("section_path"), F.lit(None).cast("string").alias("block_id"), F.lit("verified_visual").alias("content_type"), F.row_number().over(Window.partitionBy("doc_id").orderBy("candidate_id", "claim_id")).alias("_i"), F.col("statement").alias("text"))
        )
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "_i")) - 1
    out = out.withColumn("chunk_idx", turn).withColumn("token_count", text.word_count(F.col("text")))
    return out.withColumn("over_limit", F.col("token_count") > limit).drop("ord", "_i")


def core_chunks(blocks: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """The core feed: neighbouring blocks of one section merged greedily while the limit holds, longer ones split."""
    w = scans.ordered("doc_id", "ord")
    df = blocks.where("block_type not in ('heading', 'picture') and text <> ''")
    df = df.withColumn("_s", scans.island(F.array_join("section_path", "\u0001"), w))
    group = df.groupBy("doc_id", "_s").agg(F.first("section_path").alias("headings"), F.array_sort(F.collect_list(F.struct("ord", "text", "refs"))).alias("x"))
    group = once(group, _u=F.transform("x", lambda b: _whole(b["text"])))
    group = once(group, _at=greedy_starts(F.col("_u"), F.lit(limit)))
    texts = sliced(F.col("_u"), F.col("_at"), lambda own: F.array_join(F.transform(own, lambda u: u["u"]), "\n"))
    refs = sliced(F.col("x"), F.col("_at"), lambda own: F.array_distinct(F.flatten(F.transform(own, lambda b: F.coalesce(b["refs"], F.array().cast("array<string>"))))))
    merged = group.select("doc_id", "_s", "headings", F.posexplode(F.arrays_zip(texts.alias("text"), refs.alias("refs"))).alias("_i", "_p")).select("doc_id", "_s", "headings", "_i", "_p.text", "_p.refs")
    cut = split_words(merged, "text", F.array_join("headings", "\n"), limit)
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("_s", "_i", "segment_index")) - 1
    return cut.select("doc_id", turn.alias("chunk_idx"), "headings", "refs", F.col("segment").alias("text"), "segment_index", "segment_count", "token_count")


def review_queue(candidates: DataFrame, results: DataFrame, blocks: DataFrame) -> DataFrame:
    """Candidates whose result is not verified, review-0001... per document; without a result: not_reviewed."""
    df = candidates.join(results.select("doc_id", "candidate_id", F.col("status").alias("result_status")), ["doc_id", "candidate_id"], "left")
    df = df.where(F.col("result_status").isNull() | (F.col("result_status") != "verified"))
    df = df.join(blocks.select("doc_id", "block_id", F.col("block_type"), F.col("section_path")), ["doc_id", "block_id"], "left")
    status = F.coalesce("result_status", F.lit("not_reviewed"))
    action = F.when(status == "partial", "confirm_open_claims").when(status == "failed", "retry_or_review_by_hand").otherwise("review_by_hand")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("candidate_id"))
    return df.select("doc_id", F.format_string("review-%04d", turn).alias("review_id"), "candidate_id", "kind", "block_id", "block_type", "section_path", status.alias("status"), action.alias("recommended_action"))


def readiness(documents: DataFrame, chunks: DataFrame, queue: DataFrame) -> DataFrame:
    """blocked without chunks, partial_ready with a queue, else ready."""
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    q = queue.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_queued"))
    df = documents.select("doc_id").distinct().join(n, "doc_id", "left").join(q, "doc_id", "left").na.fill(0, ["n_chunks", "n_queued"])
    return df.withColumn("clean_readiness", F.when(F.col("n_chunks") == 0, "blocked").when(F.col("n_queued") > 0, "partial_ready").otherwise("ready"))


def picture_chunks(records: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """Chunks of picture texts, each with a line that names page, file, source and trust."""
    head = F.concat(F.lit("Picture text (page "), F.coalesce(F.col("page").cast("string"), F.lit("unknown")), F.lit(", "), "picture_file", F.lit(") — "), "source", F.lit(", trust "), "trust", F.lit("."))
    return split_words(records.where("text is not null and trim(text) <> ''").withColumn("_h", head), "text", F.col("_h"), limit).withColumn("contextualized_text", F.concat("_h", F.lit("\n"), "segment")).drop("_h")


def warning_chunks(findings: DataFrame) -> DataFrame:
    """Chunks of the findings that block and ask for a warning of their own."""
    own = findings.where("blocks_llm_readiness and coalesce(requires_standalone_warning, true)")
    return own.select("doc_id", "finding_id", F.concat(F.lit("[Integrity warning] "), "category", F.lit(": "), "message").alias("text")).withColumn("token_count", text.word_count(F.col("text")))
