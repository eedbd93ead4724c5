"""Chunks, gates and sources over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scans, text
from ..operators import chunks as C
from ..operators import integrity, pictures
from ..operators import lines as L
from ..plans import gates
from .registry import query, table

_WORDS = r"""w as (select doc_id, block_no, regexp_extract_all(line, '\S+') ws from (select doc_id, unnest(range(len(l))) block_no, unnest(l) line from (select doc_id, string_split(text, chr(10)) l from documents)))"""


@query(
    rf"""with {_WORDS}, s as (select doc_id, block_no, ws, ceil(len(ws) / 1200.0)::int n, unnest(range(ceil(len(ws) / 1200.0)::bigint)) i from w where len(ws) > 0)
    select doc_id, block_no::int as block_no, i::int as segment_index, n as segment_count, len(list_slice(ws, i * 1200 + 1, i * 1200 + 1200))::int as token_count, md5(array_to_string(list_slice(ws, i * 1200 + 1, i * 1200 + 1200), ' ')) as words_md5 from s"""
)
def clean_chunks_words(spark: SparkSession, d: str) -> DataFrame:
    """Documents to paragraph blocks to token-bounded chunks: the smallest whole run of the engine."""
    blocks = L.to_lines(table(spark, d, "documents"))
    out = C.split_words(blocks, "line")
    words = F.md5(F.array_join(F.regexp_extract_all("segment", F.lit(r"\S+"), F.lit(0)), " "))
    return out.select("doc_id", F.col("line_no").alias("block_no"), "segment_index", "segment_count", "token_count", words.alias("words_md5"))


@query(
    r"""with recursive s as (select doc_id, list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n\n+'), lambda x: x <> '') u, len(regexp_extract_all(text, '\S+')) total, text from documents),
    x as (select doc_id, case when len(u) = 1 then regexp_extract_all(text, '\S+\s*') else u end u from s where total > 200),
    e as (select doc_id, unnest(range(1, len(u) + 1)) i, unnest(u) t from x),
    f as (select doc_id, i, t, len(regexp_extract_all(t, '\S+')) k, regexp_matches(trim(t), '[.!?]$') stop, regexp_matches(t, '\s$') gap from e),
    r as (select doc_id, i, 0 piece, k::bigint n, stop, gap from f where i = 1
      union all select f.doc_id, f.i, case when full_up then piece + 1 else piece end, case when full_up then f.k else m end, f.stop, f.gap
      from (select r.*, f.k, f.stop fs, f.gap fg, r.n + f.k - (case when r.stop or r.gap then 0 else 1 end) m, r.n + f.k - (case when r.stop or r.gap then 0 else 1 end) > 200 full_up from r join f on f.doc_id = r.doc_id and f.i = r.i + 1) z join f on f.doc_id = z.doc_id and f.i = z.i + 1)
    select doc_id, piece::int as piece_index, max_by(n, i)::int as token_count from r group by 1, 2
    union all select doc_id, 0, total::int from s where total <= 200 and total > 0"""
)
def sentence_pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents packed by sentences into pieces of at most 200 words."""
    return C.pack_sentences(table(spark, d, "documents").select("doc_id", "text"), "text", 200).select("doc_id", "piece_index", "token_count")


@query(
    r"""with p as (select page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) h, regexp_replace(html, '<[^>]*>', ' ', 'g') t from pages),
    c as (select page_id, len(regexp_extract_all(t, '\S+')) n, 100 - len(regexp_extract_all(h, '\S+')) cap from p)
    select page_id, unnest(range(ceil(n / cap)::bigint))::int as segment_index, ceil(n / cap)::int as segment_count, least(cap, n - unnest(range(ceil(n / cap)::bigint)) * cap)::int + 100 - cap::int as token_count from c where n > 0"""
)
def chunk_limit_with_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Pages as text, split so that title and segment stay within 100 words."""
    h, t = F.regexp_extract("html", "<h1>(.*?)</h1>", 1), F.regexp_replace("html", "<[^>]*>", " ")
    pages = table(spark, d, "pages").select("page_id", h.alias("h"), t.alias("t"))
    return C.split_words(pages, "t", F.col("h"), 100).select("page_id", "segment_index", "segment_count", "token_count")


@query(
    r"""select d.doc_id, (select count(*) from (select unnest(string_split(text, chr(10))) x) where regexp_matches(x, '\S'))::bigint as n_chunks, coalesce(l.toxic, 0)::bigint as n_queued,
    case when not regexp_matches(text, '\S') then 'blocked' when coalesce(l.toxic, 0) > 0 then 'partial_ready' else 'ready' end as clean_readiness from documents d left join labels l using (doc_id)"""
)
def readiness_by_document(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    chunks = L.to_lines(docs).where(F.col("line").rlike(r"\S"))
    queue = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return C.readiness(docs, chunks, queue)


@query(
    """select doc_id, n_chars, case when ext not in ('.md', '.txt', '.pdf') then 'unsupported_extension'
    when n_chars = 0 then 'empty' when n_chars > 20000 then 'too_large' when ext = '.pdf' then 'content_mismatch' end as error
    from (select *, case lang when 'en' then '.md' when 'de' then '.txt' when 'fr' then '.exe' else '.pdf' end ext from documents)"""
)
def validation_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files whose extension follows their language: the reason each one is turned away for, if any."""
    from ..sources import files

    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".txt").when(F.col("lang") == "fr", ".exe").otherwise(".pdf")
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.concat(F.lit("/in/doc"), ext).alias("path"), F.encode("text", "UTF-8").alias("content"), F.col("n_chars").alias("length"))
    return files.validated(docs, max_size=20_000).select("doc_id", "n_chars", "error")


@query(
    r"""with b as (select page_id, regexp_extract_all(html, '(?s)<(?:h1|h2|p|li)>(.*?)</', 1) x from pages)
    select page_id, unnest(range(len(x)))::int as ord, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(unnest(x), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as text_md5 from b"""
)
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import readers

    return readers.html_blocks(table(spark, d, "pages")).select("page_id", "ord", F.md5("text").alias("text_md5"))


@query(
    r"""with b as (select page_id, regexp_extract_all(html, '(?s)<((?:h1|h2|p|li)>.*?)</', 1) x from pages), e as (select page_id, unnest(range(len(x))) ord, unnest(x) y from b),
    t as (select page_id, ord, regexp_extract(y, '^([a-z0-9]+)>', 1) tag, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(y, '^[a-z0-9]+>', ''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) s from e)
    select page_id, md5(string_agg(case tag when 'h1' then '# ' || s when 'h2' then '## ' || s when 'li' then '- ' || s else s end, chr(10) || chr(10) order by ord)) as markdown_md5, count(*)::bigint as n_blocks from t where s <> '' group by 1"""
)
def canonical_markdown(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import blocks as B
    from ..sources import readers

    found = readers.html_blocks(table(spark, d, "pages")).where("text <> ''").withColumnRenamed("page_id", "doc_id")
    md = B.markdown(found.select("doc_id", "ord", "block_type", "level", "text"))
    n = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    return md.join(n, "doc_id").select(F.col("doc_id").alias("page_id"), F.md5("markdown").alias("markdown_md5"), "n_blocks")


@query(
    """select d.doc_id, case when l.doc_id is null then 'verified' when toxic = 1 then 'review_required' when quality = 0 then 'preserved' else 'repaired_high_confidence' end as integrity_status,
      md5(case when toxic = 1 then '[Review required: toxic]' || chr(10) || text else text end) as text_md5 from documents d left join labels l using (doc_id)"""
)
def annotate_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks, labels as findings on them."""
    docs = table(spark, d, "documents").select("doc_id", F.lit(0).alias("chunk_idx"), F.array(F.col("doc_id").cast("string")).alias("refs"), "text")
    lab = table(spark, d, "labels")
    status = F.when(F.col("toxic") == 1, "review_required").when(F.col("quality") == 0, "preserved").otherwise("repaired_high_confidence")
    found = lab.select("doc_id", F.format_string("si-%04d", F.lit(1)).alias("finding_id"), status.alias("status"), F.col("doc_id").cast("string").alias("ref"), F.lit("toxic").alias("warning"))
    return integrity.annotate(docs, found).select("doc_id", "integrity_status", F.md5("text").alias("text_md5"))


@query(
    r"""with c as (select conv_id, turn, trim(text) || (case role when 'user' then ':' else '' end) t from conversations),
    f as (select *, lead(t) over (partition by conv_id order by turn) n, regexp_matches(t, '[=:]\s*$') and lead(t) over (partition by conv_id order by turn) is not null flag from c),
    g as (select *, turn - row_number() over (partition by conv_id, flag order by turn) isl from f),
    h as (select *, flag and row_number() over (partition by conv_id, flag, isl order by turn) % 2 = 1 fires from g),
    k as (select *, coalesce(lag(fires) over (partition by conv_id order by turn), false) gone from h)
    select conv_id, turn, fires as paired, md5(case when fires then t || ' ' || n else t end) as text_md5 from k where not gone"""
)
def label_value_pairing(spark: SparkSession, d: str) -> DataFrame:
    """User turns as labels that want a value, the next turn as the value."""
    label = F.concat(F.trim("text"), F.when(F.col("role") == "user", ":").otherwise(""))
    blocks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), label.alias("text"), F.lit("paragraph").alias("block_type"), F.array(F.lit("s")).alias("section_path"))
    return C.pair_labels(blocks).select(F.col("doc_id").alias("conv_id"), F.col("ord").alias("turn"), "paired", F.md5("text").alias("text_md5"))


@query(
    """select conv_id, turn, md5(last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)) as context_md5 from conversations qualify role <> 'user'"""
)
def picture_context_asof(spark: SparkSession, d: str) -> DataFrame:
    """Nearest earlier user turn of each answer."""
    w = scans.ordered("conv_id", "turn")
    df = table(spark, d, "conversations").withColumn("c", scans.previous(F.col("text"), F.col("role") == "user", w))
    return df.where("role <> 'user'").select("conv_id", "turn", F.md5("c").alias("context_md5"))


@query(
    r"""with l as (select doc_id, unnest(range(len(x))) line_no, unnest(x) line from (select doc_id, string_split(text, chr(10)) x from documents)),
    f as (select doc_id, line_no, line, regexp_matches(line, '(?i)^\s*(#|```|/[*/]|(kind|services|apiversion)\s*:|(stage|stages|pipeline|node)\s*\{|(from|docker|kubectl)\s+)') c from l),
    g as (select *, line_no - row_number() over (partition by doc_id, c order by line_no) k from f)
    select doc_id, min(line_no)::int as first_line, count(*)::bigint as n_lines, md5(string_agg(line, chr(10) order by line_no)) as code_md5 from g where c group by doc_id, k"""
)
def code_run_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Runs of lines that begin like source code."""
    lines = L.to_lines(table(spark, d, "documents")).withColumn("c", text.is_code_start(F.col("line")))
    lines = lines.withColumn("k", scans.island(F.col("c"), scans.ordered("doc_id", "line_no"))).where("c")
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("doc_id", "k").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.md5(code).alias("code_md5")).drop("k")


@query(
    r"""with l as (select doc_id, unnest(range(len(x))) line_no, unnest(x) line from (select doc_id, string_split('| A | B |' || chr(10) || '| --- | :---: |' || chr(10) || '| ' || replace(left(text, 200), chr(10), ' ') || ' | ' || lang || ' |' || chr(10) || text, chr(10)) x from documents)),
    p as (select doc_id, line_no, line, line_no - row_number() over (partition by doc_id order by line_no) k from l where regexp_matches(line, '^\s*\|')),
    c as (select doc_id, k, line_no, list_transform(string_split(regexp_replace(trim(line), '^\|+|\|+$', '', 'g'), '|'), lambda v: trim(v)) cells from p),
    t as (select doc_id, k, min(line_no) first_line, max(line_no) last_line, count(*) n, min_by(cells, line_no) header, list(cells order by line_no) x from c group by 1, 2)
    select doc_id, first_line::int as first_line, last_line::int as last_line, len(header)::int as n_columns, len(list_filter(list_slice(x, 3, 1000000), lambda r: len(r) = len(header)))::int as n_rows from t
    where n >= 2 and len(list_filter(x[2], lambda v: not regexp_full_match(v, ':?-{3,}:?'))) = 0"""
)
def table_blocks_islands(spark: SparkSession, d: str) -> DataFrame:
    """Pipe tables of documents that each begin with one."""
    head = F.concat(F.lit("| A | B |\n| --- | :---: |\n| "), F.translate(F.left("text", F.lit(200)), "\n", " "), F.lit(" | "), "lang", F.lit(" |\n"), "text")
    found = L.table_blocks(L.to_lines(table(spark, d, "documents").select("doc_id", head.alias("text"))))
    return found.select("doc_id", "first_line", "last_line", F.size("header").alias("n_columns"), F.size("rows").alias("n_rows"))


@query(
    r"""with l as (select doc_id, unnest(range(len(x))) line_no, unnest(x) line from (select doc_id, string_split(text, chr(10)) x from documents)),
    r as (select doc_id, line_no, list_transform(string_split(regexp_replace(regexp_replace(trim(line), '^\|+', ''), '\|+$', ''), '|'), lambda v: trim(v)) c from l where contains(line, '|'))
    select doc_id, line_no::int as line_no, len(c)::int as n_cells, md5(array_to_string(c, chr(9))) as cells_md5 from r"""
)
def row_parse_unescape(spark: SparkSession, d: str) -> DataFrame:
    lines = L.to_lines(table(spark, d, "documents")).where(F.col("line").contains("|"))
    cells = text.parse_row(F.col("line"))
    return lines.select("doc_id", "line_no", F.size(cells).alias("n_cells"), F.md5(F.array_join(cells, "\t")).alias("cells_md5"))


@query(
    r"""with b as (select page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) h from pages),
    l as (select page_id, unnest(['![a](p' || page_id || '.png)', h, '![b](p' || page_id || '.png)']) line, unnest([0, 1, 2]) n from b)
    select page_id, md5(string_agg(line || (case when n = 0 and page_id % 2 = 0 then chr(10) || chr(10) || '> **Picture text** (document, trust medium)' || chr(10) || '> label ' || page_id else '' end), chr(10) order by n)
      || (case when page_id % 2 = 1 then chr(10) || chr(10) || '## Extracted Image Text' || chr(10) || chr(10) || '> **Picture text** (document, trust medium)' || chr(10) || '> label ' || page_id else '' end)) as markdown_md5 from l group by page_id"""
)
def inject_after_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Picture texts put after the first image line of their file; odd pages' files are not there."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("h"))
    uri = F.concat(F.lit("p"), "doc_id", F.lit(".png"))
    lines = pages.select("doc_id", F.posexplode(F.array(F.concat(F.lit("![a]("), uri, F.lit(")")), "h", F.concat(F.lit("![b]("), uri, F.lit(")")))).alias("line_no", "line"))
    rec = pages.select("doc_id", F.lit(0).alias("rec_idx"), F.when(F.col("doc_id") % 2 == 0, uri).otherwise("none.png").alias("asset_uri"), F.concat(F.lit("label "), "doc_id").alias("text"), F.lit("document").alias("source"), F.lit("medium").alias("trust"))
    return L.to_text(pictures.inject_text(lines, rec)).select(F.col("doc_id").alias("page_id"), F.md5("markdown").alias("markdown_md5"))


@query(
    " union all ".join(f"select '{t}' as table_name, count(*)::bigint as n_rows from {t}" for t in ("documents", "pages", "conversations", "labels", "events", "orders"))
)
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    return gates.counts({t: table(spark, d, t) for t in ("documents", "pages", "conversations", "labels", "events", "orders")})


@query(
    """with s as (select doc_id, source, md5(string_split(text, chr(10))[1]) sig from documents) select source, sig as signature_md5, count(*)::bigint as n_docs from s group by 1, 2 having count(*) >= 2"""
)
def furniture_signatures(spark: SparkSession, d: str) -> DataFrame:
    """First lines that repeat within a source."""
    s = table(spark, d, "documents").select("source", F.md5(F.get(F.split("text", "\n"), F.lit(0))).alias("signature_md5"))
    return s.groupBy("source", "signature_md5").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs >= 2")
