"""Operators of headings, tables, blocks, pictures, chunks and review over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scans, text
from ..operators import blocks as B
from ..operators import chunks as C
from ..operators import integrity, pictures, review
from ..operators import lines as L
from ..plans import runs
from ..sources import files
from ..streaming import journal
from .registry import query, table


def _pick(n, *values):
    """values[key % n] as a Column."""
    out = F.when(n == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(n == i, v)
    return out


@query(
    """select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%-d/%b/%y') when 2 then strftime(o_orderdate, '%d.%m.%Y') else strftime(o_orderdate, '%-d-%B-%Y') end as said,
    o_orderkey % 4 <> 2 as is_date from orders"""
)
def date_shapes(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    said = _pick(F.col("o_orderkey") % 4, F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "d/MMM/yy"), F.date_format(at, "dd.MM.yyyy"), F.date_format(at, "d-MMMM-yyyy"))
    return table(spark, d, "orders").select("o_orderkey", said.alias("said"), text.looks_like_date(said).alias("is_date"))


@query(
    """with p as (select p_partkey k, ['claim', 'date', 'depth', 'range', 'status', 'width', 'height', 'key'][(p_partkey % 8 + 1)::int] w from part)
    select k as p_partkey, k % 8 < 6 and k % 3 < 2 as is_label, case k % 3 when 0 then upper(w) || ':' when 1 then w else w || ' of it' end as label from p"""
)
def false_label_headings(spark: SparkSession, d: str) -> DataFrame:
    """Words with a colon, a bullet or neither: field labels that are no headings."""
    k = F.col("p_partkey")
    w = F.get(F.array(*(F.lit(x) for x in "claim date depth range status width height key".split())), (k % 8).cast("int"))
    said = _pick(k % 3, F.concat(F.upper(w), F.lit(":")), F.concat(F.lit("· "), w), F.concat(w, F.lit(" of it")))
    return table(spark, d, "part").select("p_partkey", text.is_false_label_heading(said).alias("is_label"), text.bare_label(said).alias("label"))


@query(
    r"""select p_partkey, replace(p_name, ' ', ' - ') || ', of ' || p_partkey || '.' as sentence from part"""
)
def sentence_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Part names with white space before commas and around hyphens."""
    said = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("-  ")), F.lit(" , of "), "p_partkey", F.lit("  ."))
    return table(spark, d, "part").select("p_partkey", text.normalize_sentence(said).alias("sentence"))


@query(
    """with p as (select p_partkey k, array_to_string(list_transform(range(p_partkey % 9), lambda i: (p_partkey // 7 + i) % 90 + 1), '.') n, p_name t from part)
    select k as p_partkey, case when k % 9 = 0 then null else repeat('#', least(k % 9 + 1, 6)::int) || ' ' || n || ' ' || t end as heading, case when k % 9 between 1 and 6 then least(k % 9, 6)::int end as canonical_level from p"""
)
def numbered_headings(spark: SparkSession, d: str) -> DataFrame:
    """Titles numbered to a depth of none to eight: Markdown heading and level in blocks."""
    k = F.col("p_partkey")
    parts = F.when(k % 9 > 0, F.transform(F.sequence(F.lit(0), (k % 9).cast("int") - 1), lambda i: ((F.floor(k / 7) + i) % 90 + 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    said = F.ltrim(F.concat_ws(" ", F.array_join(parts, "."), "p_name"))
    return table(spark, d, "part").select("p_partkey", text.numbered_heading(said).alias("heading"), text.canonical_level(said).alias("canonical_level"))


@query(
    "select n_nationkey, case when n_nationkey % 5 = 4 then null else 'picture-' || lpad((n_nationkey + 1)::varchar, 4, '0') || '.png' end as file, n_nationkey % 5 < 3 as starts_block from nation"
)
def picture_names_and_block_starts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    ref = F.when(k % 5 == 4, F.concat(F.lit("#/pictures/x"), k)).otherwise(F.concat(F.lit("#/pictures/"), k))
    line = _pick(k % 5, F.lit("![a](b)"), F.lit("## t"), F.lit("| a |"), F.lit(" | a |"), F.lit("####### t"))
    return table(spark, d, "nation").select("n_nationkey", text.picture_name(ref).alias("file"), text.starts_block(line).alias("starts_block"))


@query(
    "select n_regionkey as doc_id, string_agg(lower(replace(n_name, ' ', '')) || n_nationkey, '' order by n_nationkey) as signature from nation group by 1"
)
def grid_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Regions as tables of their nations: one signature for equal cells however spaced and cased."""
    row = F.struct("n_nationkey", F.array(F.concat(F.lit(" "), "n_name"), F.concat(F.col("n_nationkey").cast("string"), F.lit("!"))).alias("r"))
    g = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("rows"))
    return g.select("doc_id", text.grid_signature(F.col("rows")).alias("signature"))


@query("select p_partkey, 'a ' || p_brand || ' *' || p_size || '_' as plain from part")
def emphasis_stripped(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat(F.lit("**a** __"), "p_brand", F.lit("__ \\*"), "p_size", F.lit("\\_"))
    return table(spark, d, "part").select("p_partkey", text.strip_emphasis(cell).alias("plain"))


@query("select doc_id, source || '__' || left(sha256(text), 8) || '__20240102T030405' || lpad((doc_id % 1000000)::varchar, 6, '0') as run_id from documents")
def run_names(spark: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-02 03:04:05").cast("timestamp")) + F.col("doc_id") % 1000000)
    return table(spark, d, "documents").select("doc_id", files.run_id(text.sanitize_stem(F.concat("source", F.lit(".md"))), F.sha2("text", 256), at).alias("run_id"))


_EXTS = ".pdf .docx .md .html .png .exe".split()


@query(
    """with p as (select page_id k, ['.pdf', '.docx', '.md', '.html', '.png', '.exe'][(page_id % 6 + 1)::int] ext, page_id % 5 h from pages)
    select k as page_id, case h when 0 then 'application/pdf' when 1 then 'application/zip' when 2 then 'image/png' when 3 then 'application/octet-stream' else 'text/plain' end as mime,
      case ext when '.pdf' then h = 0 when '.docx' then h = 1 when '.md' then h in (0, 1, 4) when '.html' then h = 4 when '.png' then h = 2 else false end as fits from p"""
)
def mime_extension_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Pages behind five kinds of first bytes under six extensions: type by signature, and whether the two agree."""
    k = F.col("page_id")
    ext = F.get(F.array(*(F.lit(e) for e in _EXTS)), (k % 6).cast("int"))
    head = _pick(k % 5, F.lit("255044462D"), F.lit("504B0304"), F.lit("89504E470D0A1A0A"), F.lit("410042"), F.lit("41"))
    content = F.unhex(F.concat(head, F.hex(F.encode("html", "UTF-8"))))
    mime = text.mime_by_signature(content)
    return table(spark, d, "pages").select("page_id", mime.alias("mime"), files.mime_matches(ext, mime, content).alias("fits"))


@query(
    """with i as (select l_suppkey s, l_linenumber n, l_returnflag f, l_quantity q from lineitem), a as (select s, 'h' || n g from i where f = 'A' group by all),
    b as (select s, 's' || n g from i where f = 'R' and (1000 - (1000 - q) <= 80 or 900 - q * 20 <= 80) group by s, n having count(*) >= 2) select s as doc_id, g as signature from a union select s, g from b"""
)
def page_furniture(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a supplier as page headers (flag A), section headers on a page 1000 high (R) and text: what repeats near an edge."""
    li = table(spark, d, "lineitem").where("l_returnflag in ('A', 'R')")
    own = F.col("l_returnflag") == "A"
    items = li.select(
        F.col("l_suppkey").alias("doc_id"), F.when(own, "page_header").otherwise("section_header").alias("label"), F.concat(F.when(own, "H-").otherwise("S. "), F.col("l_linenumber")).alias("text"), F.lit(1).alias("page_no"),
        (F.lit(1000) - F.col("l_quantity")).alias("top"), (F.lit(900) - F.col("l_quantity") * 20).alias("bottom"),
    )
    pages = li.select(F.col("l_suppkey").alias("doc_id")).distinct().select("doc_id", F.lit(1).alias("page_no"), F.lit(1000.0).alias("height"))
    return L.furniture(items, pages)


@query(
    """select c_custkey as doc_id, case c_custkey % 5 when 0 then '#### ' || c_name when 1 then '' when 2 then '\\# apiVersion: v1 of ' || c_custkey when 3 then '###### ' || c_name || ' x' else '# not a heading' end as line from customer""".replace("\\\\", "\\")
)
def headings_in_context(spark: SparkSession, d: str) -> DataFrame:
    """A heading of each customer that the document knows by level, as furniture, as source code, not at all, or inside a fence."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    code = F.concat(F.lit("apiVersion: v1 of "), k)
    line = _pick(k % 5, F.concat(F.lit("# "), "c_name"), F.concat(F.lit("# "), "c_name"), F.concat(F.lit("## "), code), F.concat(F.lit("########## "), "c_name", F.lit(" x")), F.lit("# not a heading"))
    fence = F.when(k % 5 == 4, "```").otherwise("")
    lines = c.select(k.alias("doc_id"), F.posexplode(F.array(fence, line, fence)).alias("line_no", "line"))
    sig = text.text_signature(F.col("c_name"))
    levels = c.where(k % 5 == 0).select(k.alias("doc_id"), sig.alias("signature"), F.lit(4).alias("doc_level"))
    known = c.where(k % 5 == 1).select(k.alias("doc_id"), sig.alias("signature"))
    starts = c.where(k % 5 == 2).select(k.alias("doc_id"), F.concat(code, F.lit(" and more")).alias("text"))
    return L.clean_headings(lines, levels, known, starts).where("line_no = 1").select("doc_id", "line")


@query(
    """with n as (select n_regionkey r, n_nationkey k, n_name || '|' || n_regionkey a from nation)
    select r as doc_id, '| Na\\|me | Key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || replace(a, '|', '\\|') || ' | ' || k || ' |', chr(10) order by k) as markdown from n group by 1""".replace("\\\\", "\\")
)
def rendered_tables(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct("n_nationkey", F.array(F.concat("n_name", F.lit("|"), "n_regionkey"), F.col("n_nationkey").cast("string")).alias("r"))
    g = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("rows"))
    return g.select("doc_id", L.render_table(F.array(F.lit("Na|me"), F.lit("Key")), F.col("rows")).alias("markdown"))


@query("select p_partkey as doc_id, case when p_partkey % 3 = 0 then 'Threshold' else 'Threshol D' end as header, (case when p_partkey % 3 = 0 then 1 else 0 end)::int as n_repairs from part")
def header_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Headers of which every third has a wrapped last letter, and the record of each repair."""
    k = F.col("p_partkey")
    t = table(spark, d, "part").select(k.alias("doc_id"), F.array(F.when(k % 3 == 0, "Threshol d").otherwise("Threshol D"), F.lit("Unit")).alias("header"))
    return L.repair_header_fragments(t).select("doc_id", F.col("header")[0].alias("header"), F.size("repairs").alias("n_repairs"))


@query(
    """with s as (select s_suppkey k, s_name, s_suppkey % 4 m from supplier)
    select k as doc_id, case m when 0 then 'x' || chr(10) || chr(10) || '| Category | Requirement |' || chr(10) || '| --- | --- |' || chr(10) || '| Security | ' || s_name || ' |' || chr(10) || '| Performance | fast |' || chr(10) || chr(10) || '# next' || chr(10)
      when 1 then 'x' || chr(10) || 'Category' || chr(10) || 'Requirement' || chr(10) || 'Security' || chr(10) || s_name || chr(10) || '# next' || chr(10)
      when 2 then 'x' || chr(10) || 'Component' || chr(10) || 'Requirement' || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' || chr(10)
      else 'x' || chr(10) || chr(10) || '| Component | Specification |' || chr(10) || '| --- | --- |' || chr(10) || '| Database | ' || s_name || ' |' || chr(10) || '| Disk Size | 5 |' || chr(10) end as markdown from s"""
)
def borderless_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two-column tables written one cell a line: whole, too short, of unknown headers, and with labels fused to their values."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    lines = _pick(
        k % 4,
        F.concat_ws("\n", F.lit("x"), F.lit("Category"), F.lit("Requirement"), F.lit("Security"), name, F.lit("Performance"), F.lit("fast"), F.lit("# next")),
        F.concat_ws("\n", F.lit("x"), F.lit("Category"), F.lit("Requirement"), F.lit("Security"), name, F.lit("# next")),
        F.concat_ws("\n", F.lit("x"), F.lit("Component"), F.lit("Requirement"), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")),
        F.concat_ws("\n", F.lit("x"), F.lit("Component"), F.lit(""), F.lit("Specification"), F.concat(F.lit("Database "), name), F.lit("Disk Size"), F.lit("5")),
    )
    return L.borderless_tables(table(spark, d, "supplier").select(k.alias("doc_id"), lines.alias("markdown")))


@query(
    """with o as (select o_custkey c, o_orderkey k, row_number() over (partition by o_custkey order by o_orderkey) - 1 i from orders), m as (select *, max(i) over (partition by c) last from o)
    select c as doc_id, i::int as table_idx, i < last and (k % 3 = 0) as adjacent_next from m"""
)
def table_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as tables of a body; after every third a page header, after the others a paragraph."""
    w = scans.ordered("o_custkey", "o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"), (F.row_number().over(w) - 1).alias("i"))
    ref = F.concat(F.lit("t"), "k")
    body = o.select("doc_id", ref.alias("ref"), (2 * F.col("i")).alias("pos"), F.lit("table").alias("label"))
    between = o.select("doc_id", F.concat(F.lit("x"), "k").alias("ref"), (2 * F.col("i") + 1).alias("pos"), F.when(F.col("k") % 3 == 0, "page_header").otherwise("text").alias("label"))
    out = integrity.with_adjacency(o.select("doc_id", F.col("i").alias("table_idx"), ref.alias("ref")), body.unionByName(between))
    return out.select("doc_id", "table_idx", "adjacent_next")


_SNAP = "with o as (select o_custkey c, o_orderkey k, row_number() over (partition by o_custkey order by o_orderkey) - 1 i from orders)"


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as two-column tables on pages of their own, each at the bottom and top of its page."""
    w = scans.ordered("o_custkey", "o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"), (F.row_number().over(w) - 1).alias("table_idx"))
    k = F.col("k")
    head = F.array(F.lit("Key"), F.when(k % 7 == 0, "Threshol d").otherwise("Value"))
    body = F.array(F.array(F.concat(F.lit("a"), k), F.lit("b")), F.array(F.concat(F.lit("c"), k, F.when(k % 5 == 0, "_").otherwise("")), F.lit("d")))
    has = k % 2 == 0
    edges = F.array(F.struct(F.lit(0.0).alias("l"), F.lit(50.0).alias("r")), F.struct(F.lit(50.0).alias("l"), F.when(k % 11 == 0, 300.0).otherwise(100.0).alias("r")))
    return o.select(
        "doc_id", "table_idx", "k", F.concat(F.lit("#/tables/"), "table_idx").alias("ref"), (F.col("table_idx") + 1).alias("page"), F.lit(790.0).alias("top"), F.lit(20.0).alias("bottom"), F.lit(800.0).alias("page_height"), F.lit(500.0).alias("page_width"),
        F.lit(2).alias("num_cols"), F.when(has, F.concat(F.array(head), body)).otherwise(body).alias("grid"), F.when(has, head).alias("header"), F.when(has, 1).otherwise(0).alias("header_rows"), edges.alias("edges"), has.alias("credible"),
    )


_PAIRED = _SNAP + """, p as (select *, k % 2 = 0 h, case when k % 7 = 0 then 'thresholdd' else '' end hs, k % 11 = 0 e, lead(k) over w nk from o window w as (partition by c order by k)),
    q as (select *, nk is not null flow, nk is not null and (k % 11 = 0) = (nk % 11 = 0) fits from p),
    r as (select *, flow and fits and h and nk % 2 = 1 inh, flow and fits and h and nk % 2 = 0 and (k % 7 = 0) = (nk % 7 = 0) rep from q),
    s as (select *, (inh or rep) and k % 5 = 0 cut, coalesce(lag(inh) over (partition by c order by k), false) got from r)"""


@query(
    _PAIRED + """, f as (select c, i, k, unnest([struct_pack(n := 1, g := 'wrapped_header_fragments', s := 'repaired_high_confidence', t := h and k % 7 = 0), struct_pack(n := 2, g := 'ambiguous_table_boundary', s := 'review_required', t := flow and not fits),
      struct_pack(n := 3, g := 'repeated_continuation_header', s := 'verified', t := rep), struct_pack(n := 5, g := 'missing_continuation_header', s := 'repaired_high_confidence', t := inh), struct_pack(n := 6, g := 'explicit_row_split', s := 'repaired_high_confidence', t := cut),
      struct_pack(n := 7, g := 'synthetic_numeric_headers', s := 'review_required', t := not h and not got)]) x from s)
    select c as doc_id, 'si-' || lpad(row_number() over (partition by c order by x.n, i)::varchar, 4, '0') as finding_id, i::int as table_idx, x.g as category, x.s as status, x.s = 'review_required' as blocks_llm_readiness from f where x.t"""
)
def integrity_findings(spark: SparkSession, d: str) -> DataFrame:
    """All table rules over the orders of each customer as fragments that page breaks cut."""
    return integrity.analyze(_snapshots(spark, d)).select("doc_id", "finding_id", "table_idx", "category", "status", "blocks_llm_readiness")


@query(
    _PAIRED + """, z as (select *, coalesce(lag(cut) over (partition by c order by k), false) lost, lag(k) over (partition by c order by k) pk from s),
    v as (select c, i, got, case when got then 'Key/' || case when pk % 7 = 0 then 'Threshol d' else 'Value' end || ';' else '' end || case when h then 'Key/' || case when k % 7 = 0 then 'Threshold' else 'Value' end || ';' else '' end
      || case when lost then '' else 'a' || k || '/b;' end || 'c' || k || case when k % 5 = 0 then '_' else '' end || case when cut then 'a' || nk || '/d b' else '/d' end as g from z)
    select c as doc_id, i::int as table_idx, g as rows, got as inherited from v"""
)
def repaired_tables(spark: SparkSession, d: str) -> DataFrame:
    """The same fragments with inherited headers, joined header words and merged rows."""
    fixed = integrity.repaired_grids(_snapshots(spark, d))
    return fixed.select("doc_id", "table_idx", F.array_join(F.transform("rows", lambda r: F.array_join(r, "/")), ";").alias("rows"), "inherited")


@query(
    r"""with c as (select conv_id, turn, ['section_header', 'text', 'list_item', 'page_footer', 'title', 'code'][(turn % 6 + 1)::int] label, case when turn % 6 = 0 then (turn % 4 + 1) || '.' || (turn % 3 + 1) || ' t ' || left(replace(text, chr(10), ' '), 20) else 't ' || text end t from conversations)
    select conv_id as doc_id, turn as ord, case when label in ('section_header', 'title') then 'heading' when label = 'list_item' then 'list_item' else 'paragraph' end as block_type,
      case when label = 'section_header' then 2 when label = 'title' then 3 end::int as level, case when label = 'section_header' then 'ambiguous' else 'verified' end as integrity_status from c where label <> 'page_footer' and trim(t) <> ''"""
)
def typed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as items of six labels; numbered headings claim level 3 and are level 2."""
    k = F.col("turn") % 6
    label = F.get(F.array(*(F.lit(x) for x in "section_header text list_item page_footer title code".split())), k.cast("int"))
    said = F.when(k == 0, F.concat((F.col("turn") % 4 + 1).cast("string"), F.lit("."), (F.col("turn") % 3 + 1).cast("string"), F.lit(" t "), F.left(F.translate("text", "\n", " "), F.lit(20)))).otherwise(F.concat(F.lit("t "), "text"))
    items = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), label.alias("label"), said.alias("text"), F.lit(3).alias("level"))
    return B.typed(items).select("doc_id", "ord", "block_type", "level", "integrity_status")


@query("select source as doc_id, doc_id as ord, 'block-' || lpad(row_number() over (partition by source order by doc_id)::varchar, 5, '0') as block_id from documents")
def block_numbers(spark: SparkSession, d: str) -> DataFrame:
    return B.numbered(table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"))).select("doc_id", "ord", "block_id")


@query(
    """with b as (select n_regionkey d, row_number() over (partition by n_regionkey order by n_nationkey) - 1 o, n_nationkey k from nation),
    p as (select s_nationkey % 5 d, s_suppkey k, row_number() over (partition by s_nationkey % 5 order by s_suppkey) - 1 i, s_nationkey n from supplier),
    a as (select p.*, b.o at_ from p left join b on b.d = p.d and b.k = p.n),
    u as (select d, o a, 0 b, 'paragraph' t, 'r' || k ref, null::boolean m from b union all select d, coalesce(at_, 9000000), i + 1, 'picture', 'p' || k, at_ is not null from a)
    select d as doc_id, (row_number() over (partition by d order by a, b) - 1)::int as ord, t as block_type, ref, m as anchor_matched from u"""
)
def placed_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as pictures beside the nation that is their parent, or at the end of the region they are in."""
    w = scans.ordered("n_regionkey", "n_nationkey")
    b = table(spark, d, "nation").select(F.col("n_regionkey").alias("doc_id"), (F.row_number().over(w) - 1).alias("ord"), F.array(F.concat(F.lit("r"), "n_nationkey")).alias("refs"), F.lit("paragraph").alias("block_type"), F.lit("x").alias("text"), F.array(F.lit("s")).alias("section_path"), F.lit("verified").alias("integrity_status"))
    key = (F.col("s_nationkey") % 5).alias("doc_id")
    p = table(spark, d, "supplier").select(key, "s_suppkey", "s_nationkey")
    p = p.select("doc_id", (F.row_number().over(scans.ordered("doc_id", "s_suppkey")) - 1).alias("pic_idx"), F.concat(F.lit("p"), "s_suppkey").alias("ref"), F.concat(F.lit("r"), "s_nationkey").alias("parent_ref"), F.lit("u").alias("asset_uri"))
    return B.insert_pictures(b, p).select("doc_id", "ord", "block_type", F.col("refs")[0].alias("ref"), "anchor_matched")


@query(
    """with f as (select o_custkey d, o_orderkey k, 'si-' || o_orderkey id, o_orderpriority cat, o_orderstatus = 'P' or o_orderkey % 50 = 0 bad from orders)
    select c_custkey as doc_id, coalesce(string_agg(id, ',' order by id), '') as ids, case when bool_or(bad) then 'review_required' else 'verified' end as integrity_status,
      coalesce(array_to_string(list_sort(list_distinct(list(cat) filter (where bad))), ','), '') as reasons from customer left join f on d = c_custkey group by 1"""
)
def attached_findings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as findings on the only block of their customer."""
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("ord"), F.array(F.lit("r")).alias("refs"), F.lit("verified").alias("integrity_status"), F.array().cast("array<string>").alias("reasons"))
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("si-"), "o_orderkey").alias("finding_id"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderstatus") == "P", "review_required").otherwise("verified").alias("status"), (F.col("o_orderkey") % 50 == 0).alias("blocks_llm_readiness"), F.lit("r").alias("ref"))
    out = B.attach_findings(b, f)
    return out.select("doc_id", F.array_join("integrity_finding_ids", ",").alias("ids"), "integrity_status", F.array_join(F.array_sort("reasons"), ",").alias("reasons"))


@query(
    """with b as (select source d, doc_id o, case lang when 'en' then 'picture' when 'de' then 'paragraph' else 'list_item' end t, case when lang in ('de', 'fr') and doc_id % 3 = 0 then 'ambiguous' else 'verified' end st, doc_id % 7 = 0 f from documents),
    a as (select d, 0 k, o, 'diagram' kind, 'block-' || o ref from b where t = 'picture' and f union all select d, 1, o, 'structural_ambiguity', 'block-' || o from b where t <> 'picture' and st = 'ambiguous')
    select d as doc_id, 'ai-' || lpad(row_number() over (partition by d order by k, o)::varchar, greatest(4, length((row_number() over (partition by d order by k, o))::varchar))::int, '0') as candidate_id, kind, ref as block_id from a"""
)
def review_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents as blocks of their source: pictures with a finding and unclear texts, numbered in order."""
    k = F.col("doc_id")
    kind = F.when(F.col("lang") == "en", "picture").when(F.col("lang") == "de", "paragraph").otherwise("list_item")
    none = F.array().cast("array<string>")
    b = table(spark, d, "documents").select(
        F.col("source").alias("doc_id"), k.cast("int").alias("ord"), kind.alias("block_type"), F.when(F.col("lang").isin("de", "fr") & (k % 3 == 0), "ambiguous").otherwise("verified").alias("integrity_status"), F.when(k % 7 == 0, F.array(F.lit("si-0001"))).otherwise(none).alias("integrity_finding_ids"),
        none.alias("reasons"), F.array(k.cast("string")).alias("refs"), F.lit("u").alias("asset_uri"), F.concat(F.lit("block-"), k).alias("block_id"),
    )
    f = spark.createDataFrame([], "doc_id string, finding_id string, status string, category string, ref string")
    r = spark.createDataFrame([], "doc_id string, asset_uri string, text string")
    return B.candidates(b, f, r).select("doc_id", "candidate_id", "kind", "block_id")


@query(
    """with c as (select conv_id, turn, role, ['section_header', 'text', 'picture'][(turn % 3 + 1)::int] label, 'h' || turn t, (turn % 6 + 1)::int lv from conversations)
    select conv_id as doc_id, turn as ord, last_value(case when label = 'section_header' then t end ignore nulls) over w as context_heading, least(last_value(case when label = 'section_header' then lv end ignore nulls) over w + 1, 6)::int as heading_ceiling
    from c window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) qualify label = 'picture'"""
)
def picture_headings(spark: SparkSession, d: str) -> DataFrame:
    """Every third turn as a picture: the section header before it and the deepest level of its own headings."""
    k = F.col("turn")
    label = F.get(F.array(F.lit("section_header"), F.lit("text"), F.lit("picture")), (k % 3).cast("int"))
    items = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), k.alias("ord"), label.alias("label"), F.concat(F.lit("h"), k).alias("text"), (k % 6 + 1).cast("int").alias("level"))
    return pictures.nearest_heading(items).select("doc_id", "ord", "context_heading", "heading_ceiling")


@query(
    """with i as (select o_custkey d, o_orderkey k, case o_orderkey % 4 when 0 then 'section_header' when 1 then 'page_footer' else 'text' end label, case when o_orderkey % 6 = 2 then '  ' else o_orderpriority end t from orders),
    p as (select d, k, label, trim(t) t, (case when label = 'section_header' then least(5, d % 6 + 1) end)::int lv from i where label <> 'page_footer' and trim(t) <> '' and trim(t) <> '5-LOW')
    select d as doc_id, count(*)::bigint as n_items, sum(lv)::bigint as sum_levels, sum(length(t)) >= 40 or count(*) >= 4 or bool_or(label = 'section_header') as structured from p group by 1"""
)
def picture_items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as texts inside the only picture of their customer: furniture and blanks go, levels end at the ceiling."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("t"), k).alias("ref"), _pick(k % 4, F.lit("section_header"), F.lit("page_footer"), F.lit("text"), F.lit("text")).alias("label"), F.when(k % 6 == 2, "  ").otherwise(F.col("o_orderpriority")).alias("text"), F.when(k % 4 == 0, 5).alias("level"))
    pics = o.groupBy("doc_id").agg(F.collect_list("ref").alias("children")).select("doc_id", F.lit(0).alias("pic_idx"), "children", (F.col("doc_id") % 6 + 1).cast("int").alias("heading_ceiling"))
    known = o.select("doc_id").distinct().select("doc_id", F.lit("5low").alias("signature"))
    kids = pictures.child_items(pics, o, known)
    useful = pictures.useful_structured(kids.select("doc_id", F.col("pic_idx").alias("ref"), "label", "text"))
    return kids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("level").alias("sum_levels")).join(useful.select("doc_id", "structured"), "doc_id")


@query(
    """with p as (select p_partkey k, p_partkey // 50 d, ['structured_text', 'ocr_text', 'ocr_failed', 'below_threshold', 'ocr_empty'][(p_partkey % 5 + 1)::int] s from part)
    select d as doc_id, 'vi-' || lpad(row_number() over (partition by d order by k)::varchar, 4, '0') as finding_id, case when s = 'ocr_text' then 'low_trust_picture_ocr' else 'unverified_picture_text' end as category, 'p' || k as ref from p where s not in ('structured_text', 'below_threshold')"""
)
def picture_findings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    s = F.get(F.array(*(F.lit(x) for x in "structured_text ocr_text ocr_failed below_threshold ocr_empty".split())), (k % 5).cast("int"))
    cov = table(spark, d, "part").select(F.floor(k / 50).alias("doc_id"), k.alias("pic_idx"), (s != "below_threshold").alias("qualifying"), s.alias("coverage_status"), F.concat(F.lit("p"), k).alias("ref"))
    return pictures.picture_findings(cov).select("doc_id", "finding_id", "category", "ref")


@query(
    """with b as (select page_id k, 'p' || page_id || '.png' u, page_id % 3 m from pages)
    select k as page_id, '![a](' || u || ')' || case when m = 0 then chr(10) || chr(10) || '> **Review required:** no verified text of this picture (ocr_failed); look at the picture itself.' else '' end || chr(10) || 'x' || chr(10) || '![b](' || u || ')'
      || case when m = 1 then chr(10) || chr(10) || '## Unresolved Image Content' || chr(10) || chr(10) || '### f' || k || chr(10) || '> **Review required:** no verified text of this picture (ocr_failed); look at the picture itself.' else '' end as markdown from b"""
)
def picture_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warnings beside pictures without text, at the end for those that no line shows, none for those whose text is known."""
    k = F.col("page_id")
    uri = F.concat(F.lit("p"), k, F.lit(".png"))
    pages = table(spark, d, "pages")
    lines = pages.select(k.alias("doc_id"), F.posexplode(F.array(F.concat(F.lit("![a]("), uri, F.lit(")")), F.lit("x"), F.concat(F.lit("![b]("), uri, F.lit(")")))).alias("line_no", "line"))
    cov = pages.select(k.alias("doc_id"), F.lit(0).alias("pic_idx"), F.when(k % 3 == 1, "none.png").otherwise(uri).alias("asset_uri"), F.lit(True).alias("qualifying"), F.when(k % 3 == 2, "ocr_text").otherwise("ocr_failed").alias("coverage_status"), F.concat(F.lit("f"), k).alias("picture_file"))
    return L.to_text(pictures.inject_warnings(lines, cov)).select(F.col("doc_id").alias("page_id"), "markdown")


@query(
    """select p_partkey, case p_partkey % 3 when 0 then 'p,c,i' when 1 then 'p,i' else 'u' end as refs, case when p_partkey % 4 = 0 then 'page' when p_partkey % 4 = 1 then 'section_only' else 'unavailable' end as scope from part"""
)
def source_references(spark: SparkSession, d: str) -> DataFrame:
    """References of a picture, its context and its items, each once; and how far chunks can be traced."""
    k = F.col("p_partkey")
    none = F.lit(None).cast("array<string>")
    own = F.when(k % 3 < 2, F.lit("p"))
    context = F.when(k % 3 == 0, F.array(F.lit("c"), F.lit("p"))).otherwise(none)
    items = F.when(k % 3 < 2, F.array(F.lit("i"), F.lit("i"))).otherwise(none)
    from ..plans import gates

    scope = gates.chunk_scope(F.when(k % 4 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), F.when(k % 4 < 2, F.array(F.lit("h"))).otherwise(F.array().cast("array<string>")))
    return table(spark, d, "part").select("p_partkey", F.array_join(pictures.source_refs(own, context, items, F.lit("u")), ",").alias("refs"), scope.alias("scope"))


@query(
    r"""with recursive l as (select doc_id d, unnest(string_split(text, chr(10))) x, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from documents), c as (select d, i, len(regexp_extract_all(x, '\S+')) k from l),
    r as (select d, i, 0 p, k n from c where i = 1 union all select c.d, c.i, case when r.n + c.k > 100 then p + 1 else p end, case when r.n + c.k > 100 then c.k else r.n + c.k end from r join c on c.d = r.d and c.i = r.i + 1)
    select d as doc_id, p::int as piece_index, max(n)::int as token_count from r group by 1, 2"""
)
def code_piece_packing(spark: SparkSession, d: str) -> DataFrame:
    """Documents as source code cut at line ends into pieces of at most 100 words."""
    return C.code_chunks(table(spark, d, "documents").select("doc_id", "text"), 100).select("doc_id", "piece_index", "token_count")


@query(
    r"""with t as (select doc_id, len(regexp_extract_all(text, '\S+')) n, 'Picture text (page ' || case when doc_id % 2 = 0 then (doc_id % 9)::varchar else 'unknown' end || ', f.png) — document, trust medium.' h from documents where trim(text) <> ''),
    u as (select *, 200 - len(regexp_extract_all(h, '\S+')) cap from t) select doc_id, unnest(range(ceil(n / cap)::bigint))::int as segment_index, (least(cap, n - unnest(range(ceil(n / cap)::bigint)) * cap) + 200 - cap)::int as token_count, md5(h) as head_md5 from u where n > 0"""
)
def picture_text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as texts of pictures, cut so that the line that names their source fits into 200 words as well."""
    k = F.col("doc_id")
    rec = table(spark, d, "documents").select("doc_id", "text", F.when(k % 2 == 0, k % 9).alias("page"), F.lit("f.png").alias("picture_file"), F.lit("document").alias("source"), F.lit("medium").alias("trust"))
    return C.picture_chunks(rec, 200).select("doc_id", "segment_index", "token_count", F.md5(F.get(F.split("contextualized_text", "\n"), F.lit(0))).alias("head_md5"))


@query(
    """select o_custkey as doc_id, 'si-' || o_orderkey as finding_id, '[Integrity warning] ' || o_orderpriority || ': order ' || o_orderkey as text from orders where o_orderstatus = 'P' and o_orderkey % 3 <> 0"""
)
def warning_texts(spark: SparkSession, d: str) -> DataFrame:
    """Blocking findings as chunks of their own, but those that ask for none."""
    k = F.col("o_orderkey")
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("si-"), k).alias("finding_id"), F.col("o_orderpriority").alias("category"), F.concat(F.lit("order "), k).alias("message"), (F.col("o_orderstatus") == "P").alias("blocks_llm_readiness"), F.when(k % 3 == 0, False).when(k % 3 == 1, True).alias("requires_standalone_warning"))
    return C.warning_chunks(f).select("doc_id", "finding_id", "text")


@query(
    r"""with b as (select source d, doc_id o, text, len(regexp_extract_all(text, '\S+')) n, lang from documents where trim(text) <> ''), s as (select d, o, lang, n, text, row_number() over (partition by d order by o) - row_number() over (partition by d, lang order by o) g from b)
    select d as doc_id, count(*)::bigint as n_sections, sum(k)::bigint as n_words from (select d, lang, g, sum(n) k from s group by 1, 2, 3) group by 1"""
)
def core_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source as blocks whose language is their section: no word of a section is lost or doubled by merging and splitting."""
    b = table(spark, d, "documents").where("trim(text) <> ''").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"), "text", F.lit("paragraph").alias("block_type"), F.array("lang").alias("section_path"), F.array(F.col("doc_id").cast("string")).alias("refs"))
    out = C.core_chunks(b.where(F.col("text").rlike(r"\S")), 300).withColumn("first", (F.col("segment_index") == 0) & (F.col("headings") != F.coalesce(F.lag("headings").over(scans.ordered("doc_id", "chunk_idx")), F.array().cast("array<string>"))))
    return out.groupBy("doc_id").agg(F.count_if("first").alias("n_sections"), F.sum(F.col("token_count") - 1).cast("long").alias("n_words"))


@query(
    """with d as (select doc_id, text, 'ai-' || lpad((doc_id % 9000 + 1)::varchar, 4, '0') cid, case when doc_id % 4 = 0 then '' else md5(string_split(text, chr(10))[1]) end ev, (doc_id * 7919) % 97 s from documents),
    k as (select *, case when ev = '' then 'own ' || doc_id || cid else ev end e from d), b as (select *, row_number() over (partition by e order by s desc, (doc_id % 9000 + 1), cid, doc_id::varchar) = 1 f from k),
    r as (select e, row_number() over (order by s desc, (doc_id % 9000 + 1), cid, doc_id::varchar) n, doc_id i from b where f), t as (select * from r where n <= 20)
    select k.doc_id, (case when t.i = k.doc_id then t.n end)::int as rank, coalesce(t.i = k.doc_id, false) as selected, case when t.i = k.doc_id then null when t.i is not null then 'duplicate_evidence' else 'candidate_limit' end as reason from k left join t on t.e = k.e"""
)
def corpus_selection(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best candidates of a corpus, one for each piece of evidence; ids repeat from document to document."""
    k = F.col("doc_id")
    c = table(spark, d, "documents").select("doc_id", F.concat(F.lit("ai-"), F.lpad((k % 9000 + 1).cast("string"), 4, "0")).alias("candidate_id"), (k * 7919 % 97).alias("score"), F.when(k % 4 == 0, "").otherwise(F.md5(F.get(F.split("text", "\n"), F.lit(0)))).alias("evidence"))
    return review.select_run(c, 20).select("doc_id", "rank", "selected", "reason")


@query(
    """select o_orderkey, case o_orderkey % 4 when 0 then true when 1 then false when 2 then true else false end as valid from orders"""
)
def evidence_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of evidence: whole, out of range, without a box, and upside down."""
    k = (F.col("o_orderkey") % 4).cast("int")
    box = _pick(k, F.array(F.lit(0), F.lit(0), F.lit(10), F.lit(1000)), F.array(F.lit(0), F.lit(0), F.lit(10), F.lit(1001)), F.array().cast("array<int>"), F.array(F.lit(20), F.lit(0), F.lit(10), F.lit(5)))
    regions = F.array(F.struct(F.lit(0).alias("index"), box.alias("box")))
    return table(spark, d, "orders").select("o_orderkey", review.valid_regions(regions, F.lit(1)).alias("valid"))


@query(
    """select o_custkey as doc_id, 'ai-' || o_orderkey as candidate_id, case when o_orderkey % 3 = 0 then 'better ' || o_orderkey else o_orderpriority end as statement from orders where o_orderstatus = 'F'"""
)
def verified_supplements(spark: SparkSession, d: str) -> DataFrame:
    """Orders as claims; finished ones are verified, every third in other words."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    key = [F.col("o_custkey").alias("doc_id"), F.concat(F.lit("ai-"), k).alias("candidate_id"), F.lit("c1").alias("claim_id")]
    claims = o.select(*key, F.col("o_orderpriority").alias("statement"))
    verdicts = o.select(*key, F.when(F.col("o_orderstatus") == "F", "verified").otherwise("rejected").alias("verdict"), F.when(k % 3 == 0, F.concat(F.lit("better "), k)).alias("corrected_statement"))
    return review.supplements(claims, verdicts).select("doc_id", "candidate_id", "statement")


@query(
    """select s_suppkey as doc_id, case when s_suppkey % 3 = 0 then 'heading' when s_suppkey % 3 = 1 then 'picture' else 'paragraph' end as block_type, (case when s_suppkey % 3 = 0 then least(6, greatest(1, s_suppkey % 9)) end)::int as level, case when s_suppkey % 3 = 0 then 'ai_verified' else 'ambiguous' end as integrity_status from supplier"""
)
def verified_overlays(spark: SparkSession, d: str) -> DataFrame:
    """Types that a review confirmed, put on blocks that are no pictures; levels end at 1 and 6."""
    k = F.col("s_suppkey")
    b = table(spark, d, "supplier").select(k.alias("doc_id"), F.lit("b").alias("block_id"), F.when(k % 3 == 1, "picture").otherwise("paragraph").alias("block_type"), F.lit(None).cast("int").alias("level"), F.lit("ambiguous").alias("integrity_status"))
    over = b.where(F.col("doc_id") % 3 < 2).select("doc_id", "block_id", F.lit("heading").alias("new_type"), (F.col("doc_id") % 9).cast("int").alias("new_level"))
    return review.overlay(b, over).select("doc_id", "block_type", "level", "integrity_status")


@query(
    """select s_suppkey, case when s_suppkey % 3 = 0 and s_suppkey % 2 = 0 then 'Unavailable' else (s_suppkey % 2)::varchar end as pages_shown from supplier"""
)
def page_metrics(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = F.when((k % 3 == 0) & (k % 2 == 0), F.lit(None).cast("int")).otherwise((k % 2).cast("int"))
    df = table(spark, d, "supplier").select("s_suppkey", F.when(k % 3 == 0, ".docx").otherwise(".pdf").alias("extension"), n.alias("n_pages"))
    return runs.page_metric(df).select("s_suppkey", "pages_shown")


@query("""select time_bucket(interval 1 hour, ts) as starts, event_type, count(*)::bigint as n_events from events group by 1, 2""")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour: the windows of the stream extension over a whole file."""
    out = journal.windowed(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "1 hour", "event_type")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("starts"), "event_type", "n_events")


@query("select p_partkey, greatest(1, p_partkey % 9 - 4)::bigint as n, p_partkey % 2 = 0 as transient from part")
def retries_and_limits(spark: SparkSession, d: str) -> DataFrame:
    """Errors that another try may mend, by their text."""
    k = F.col("p_partkey")
    error = F.when(k % 2 == 0, "Error 503: service unavailable").otherwise("bad JSON")
    return table(spark, d, "part").select("p_partkey", F.greatest(F.lit(1), k % 9 - 4).alias("n"), review.is_transient(error).alias("transient"))


@query(
    """with a as (select doc_id % 3 d, doc_id o, lang g, row_number() over (partition by doc_id % 3, lang order by doc_id) t from documents), b as (select doc_id % 3 d, doc_id o, lang g, row_number() over (partition by doc_id % 3, lang order by doc_id) t from documents where doc_id % 2 = 0)
    select a.d as doc_id, a.o as ord, 'r' || b.o as ref from a left join b on a.d = b.d and a.g = b.g and a.t = b.t"""
)
def refs_in_turn(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs whose signature is a language get the refs of every second document of that language, first come first served."""
    k = F.col("doc_id")
    own = table(spark, d, "documents").select((k % 3).alias("doc_id"), k.alias("ord"), F.col("lang").alias("signature"))
    items = own.where("ord % 2 = 0").withColumn("ref", F.concat(F.lit("r"), "ord"))
    return B.matched_refs(own, items).select("doc_id", "ord", "ref")


@query(
    _PAIRED + """, f as (select c, i, k, unnest([struct_pack(n := 1, s := 'repaired_high_confidence', t := h and k % 7 = 0, x := [i]), struct_pack(n := 2, s := 'review_required', t := flow and not fits, x := [i, i + 1]), struct_pack(n := 3, s := 'verified', t := rep, x := [i, i + 1]),
      struct_pack(n := 5, s := 'repaired_high_confidence', t := inh, x := [i, i + 1]), struct_pack(n := 6, s := 'repaired_high_confidence', t := cut, x := [i, i + 1]), struct_pack(n := 7, s := 'review_required', t := not h and not got, x := [i])]) x from s),
    g as (select c, 'si-' || lpad(row_number() over (partition by c order by x.n, i)::varchar, 4, '0') id, x from f where x.t)
    select c as doc_id, id as folder, (unnest(x.x) + 1)::int as table_number, 'table-fragment-' || lpad((unnest(x.x) + 1)::varchar, 4, '0') || '.png' as file from g where x.s <> 'verified'"""
)
def finding_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Table fragments that back the findings on the orders of each customer."""
    return integrity.evidence(integrity.analyze(_snapshots(spark, d))).select("doc_id", "folder", "table_number", "file")


@query(
    """select event_id as no, strftime(ts, '%H:%M:%S') as time, event_type as event, user_id || '/0' as calls, 'EUR ' || printf('%.2f', value) as spend, printf('%.1fs', event_id % 100 / 10.0) as elapsed, 0::bigint as thinking, null::varchar as message from events where event_type is not null"""
)
def journal_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type is not null").select(F.col("event_id").alias("sequence"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_type").alias("event"), F.col("user_id").alias("requests"), F.col("value").alias("spent"), (F.col("event_id") % 100 / 10).alias("elapsed_seconds"))
    return journal.event_rows(e, "EUR ").select("no", "time", "event", "calls", "spend", "elapsed", "thinking", "message")


@query(
    """with recursive o as (select o_custkey c, o_orderkey k, row_number() over (partition by o_custkey order by o_orderkey) - 1 i from orders), p as (select *, lead(k) over w nk from o window w as (partition by c order by k)),
    q as (select *, coalesce(k % 4 = nk % 4 and k % 5 <> 0 and nk % 7 <> 0, false) f from p), r as (select c, i, k, nk, f fires, false gone from q where i = 0
      union all select q.c, q.i, q.k, q.nk, q.f and not r.fires, r.fires from r join q on q.c = r.c and q.i = r.i + 1),
    t as (select *, case when k % 3 = 0 then '_' else '' end x, case when nk % 3 = 0 then '_' else '' end y from r where not gone)
    select c as doc_id, i::int as table_idx, fires as merged, 'a' || k || '/b;c' || k || x || case when not fires then '/d' when x = '_' then 'a' || nk || '/d b;c' || nk || y || '/d' else '/d;a' || nk || '/b;c' || nk || y || '/d' end as rows from t"""
)
def continued_tables(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as pipe tables on pages of their own: those of one kind that touch the page break become one."""
    w = scans.ordered("o_custkey", "o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"), (F.row_number().over(w) - 1).alias("table_idx"))
    k = F.col("k")
    kind = _pick(k % 4, F.lit("Key of the first"), F.lit("Column two"), F.lit("A third one"), F.lit("x"))
    rows = F.array(F.array(F.concat(F.lit("a"), k), F.lit("b")), F.array(F.concat(F.lit("c"), k, F.when(k % 3 == 0, "_").otherwise("")), F.lit("d")))
    t = o.select("doc_id", "table_idx", F.array(kind, F.lit("Value")).alias("header"), rows.alias("rows"), (F.col("table_idx") + 1).alias("page"), F.when(k % 7 == 0, 400.0).otherwise(790.0).alias("top"), F.when(k % 5 == 0, 300.0).otherwise(20.0).alias("bottom"), F.lit(800.0).alias("page_height"))
    return L.merge_continued_tables(t).select("doc_id", "table_idx", "merged", F.array_join(F.transform("rows", lambda r: F.array_join(r, "/")), ";").alias("rows"))


@query("""select doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}') as cache_key from documents""")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", review.cache_key(F.col("doc_id"), F.col("lang")).alias("cache_key"))


@query("select p_partkey, case when p_size % 4 = 0 or p_partkey % 5 = 0 then 'unresolved' when p_size % 4 <= p_partkey % 5 then 'verified' else 'partial' end as status from part")
def result_states(spark: SparkSession, d: str) -> DataFrame:
    """Claims of a part and how many of them are verified."""
    n = F.col("p_size") % 4
    return table(spark, d, "part").select("p_partkey", review.result_status(n, F.least(n, F.col("p_partkey") % 5)).alias("status"))


@query("select source || '/' || doc_id || '.md' as path, strlen(text)::bigint as size_bytes from documents")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return files.inventory(docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.octet_length("text").cast("long").alias("length")))
