"""Table integrity over lineitem and orders: an order stands for a table, its lines for rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scans, text
from ..operators import integrity
from .registry import query, table

_FLAG = "(l_orderkey % 3 = 0 and l_linenumber = 1)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Three cells a line: flag, status, part; every third order marks its first line as a header."""
    li = table(spark, d, "lineitem")
    values = F.array(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_partkey").cast("string"))
    df = li.select("l_orderkey", "l_linenumber", "l_quantity", ((F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") == 1)).alias("h"), F.posexplode(values).alias("c", "v"))
    x = F.col("c") * 100 + F.col("l_quantity")
    return df.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("table_idx"), F.col("v").alias("text"), F.col("l_linenumber").cast("int").alias("start_row"), (F.col("l_linenumber") + 1).cast("int").alias("end_row"),
        F.col("c").alias("start_col"), (F.col("c") + 1).alias("end_col"), F.col("h").alias("column_header"), x.alias("left"), (x + 50).alias("right"),
    )


@query(
    rf"""with g as (select l_orderkey o, l_linenumber n, [l_returnflag, l_linestatus, l_partkey::varchar] v, {_FLAG} h from lineitem),
    u as (select o, n, v, h from g qualify row_number() over (partition by o, n order by v[3]) = 1),
    t as (select o, count(*) n_rows, max_by(v, n) filter (where h) header, min(n) first_n from u group by 1)
    select o as doc_id, n_rows::int as n_rows, case when header is null then 0 else 1 end::int as has_header,
      coalesce(header is not null and len(list_filter(header, lambda x: trim(x) = '')) = 0 and len(list_distinct(list_transform(header, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')))) = 3 and len(list_filter(header, lambda x: not regexp_matches(x, '^[0-9]+$'))) > 0, false) as credible from t where o not in (select l_orderkey from lineitem group by l_orderkey, l_linenumber having count(*) > 1)"""
)
def snapshots_header_credible(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    dup = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("l_orderkey").alias("doc_id")).distinct()
    cells = cells.join(dup, "doc_id", "left_anti")
    g = integrity.grid(cells)
    per = g.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_rows"), F.max_by(F.when(F.col("is_header"), F.col("values")), F.when(F.col("is_header"), F.col("row"))).alias("header"))
    return per.select("doc_id", "n_rows", F.col("header").isNotNull().cast("int").alias("has_header"), F.coalesce(integrity.is_credible(F.col("header")), F.lit(False)).alias("credible"))


@query(
    """with e as (select l_orderkey doc_id, c, min(c * 100 + l_quantity) l, max(c * 100 + l_quantity + 50) r from lineitem, (select unnest(range(3)) c) group by 1, 2)
    select doc_id, array_to_string(list(l::int::varchar || '-' || r::int::varchar order by c), ',') as edges from e group by 1"""
)
def column_edges(spark: SparkSession, d: str) -> DataFrame:
    out = integrity.column_edges(_cells(spark, d))
    return out.select("doc_id", F.array_join(F.transform("edges", lambda e: F.concat(e["l"].cast("int").cast("string"), F.lit("-"), e["r"].cast("int").cast("string"))), ",").alias("edges"))


@query(
    """with e as (select l_orderkey o, min(l_quantity) l, max(l_quantity) + 50 r, count(distinct l_linenumber) k from lineitem group by 1), p as (select *, lead(l) over (order by o) l2, lead(r) over (order by o) r2, lead(k) over (order by o) k2, lead(o) over (order by o) o2 from (select * , o // 1000 b from e))
    select o as doc_id, o2 as next_id, k = k2 and abs(l - l2) <= 17.5 and abs(r - r2) <= 17.5 as compatible from (select o, k, l, r, lead(o) over (partition by o // 1000 order by o) o2, lead(l) over (partition by o // 1000 order by o) l2, lead(r) over (partition by o // 1000 order by o) r2, lead(k) over (partition by o // 1000 order by o) k2 from e) where o2 is not null"""
)
def compatible_columns(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring orders as fragments on pages 500 wide: do their columns fit?"""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("l"), (F.max("l_quantity") + 50).alias("r"), F.count_distinct("l_linenumber").alias("k"))
    df = li.select(F.col("l_orderkey").alias("doc_id"), F.floor(F.col("l_orderkey") / 1000).alias("b"), "k", F.array(F.struct("l", "r")).alias("e"))
    w = scans.ordered("b", "doc_id")
    df = df.withColumns({"next_id": F.lead("doc_id").over(w), "e2": F.lead("e").over(w), "k2": F.lead("k").over(w)}).where("next_id is not null")
    return df.select("doc_id", "next_id", integrity.compatible_columns(F.col("e"), F.col("e2"), F.col("k"), F.col("k2"), F.lit(500.0)).alias("compatible"))


@query(
    """with f as (select o_custkey doc_id, case when o_orderstatus = 'F' then 'preserved' when o_orderstatus = 'O' then 'repaired_high_confidence' else 'review_required' end s, o_orderstatus = 'F' and o_orderkey % 97 = 0 b from orders),
    g as (select doc_id, count(*) filter (where s = 'preserved') p, count(*) filter (where s = 'repaired_high_confidence') r, count(*) filter (where s = 'review_required') q, count(*) filter (where b) b from f group by 1)
    select c_custkey as doc_id, coalesce(p, 0)::bigint as n_preserved, coalesce(r, 0)::bigint as n_repaired_high_confidence, coalesce(q, 0)::bigint as n_review_required, coalesce(b, 0)::bigint as n_blocking, case when coalesce(q, 0) > 0 or coalesce(b, 0) > 0 then 'review_required' else 'ready' end as readiness
    from customer left join g on doc_id = c_custkey"""
)
def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    """Orders as findings on their customer."""
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    s = F.when(F.col("o_orderstatus") == "F", "preserved").when(F.col("o_orderstatus") == "O", "repaired_high_confidence").otherwise("review_required")
    found = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), s.alias("status"), ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 97 == 0)).alias("blocks_llm_readiness"))
    return integrity.report(docs, found)


@query(
    "select user_id, case max(case event_type when 'error' then 4 when 'purchase' then 3 when 'click' then 2 else 1 end) when 4 then 'review_required' when 3 then 'repaired_high_confidence' when 2 then 'preserved' else 'verified' end as worst from events group by 1"
)
def worst_status(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("event_type") == "error", "review_required").when(F.col("event_type") == "purchase", "repaired_high_confidence").when(F.col("event_type") == "click", "preserved").otherwise("verified")
    return table(spark, d, "events").select("user_id", s.alias("s")).groupBy("user_id").agg(integrity.worst_status(F.col("s")).alias("worst"))


@query(
    """with recursive o as (select o_custkey c, o_orderkey k, row_number() over (partition by o_custkey order by o_orderkey) i, coalesce(o_orderstatus = lead(o_orderstatus) over (partition by o_custkey order by o_orderkey), false) f from orders),
    r as (select c, k, i, f, f fires from o where i = 1 union all select o.c, o.k, o.i, o.f, o.f and not r.fires from r join o on o.c = r.c and o.i = r.i + 1)
    select c as doc_id, k as first_id from r where fires"""
)
def continued_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring orders of a customer with one status as fragments of one table: pairs that a greedy scan joins."""
    w = scans.ordered("o_custkey", "o_orderkey")
    df = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.coalesce(F.col("o_orderstatus") == F.lead("o_orderstatus").over(w), F.lit(False)).alias("f"))
    out = scans.odd_in_run(df, "f", ["o_custkey"], ["o_orderkey"])
    return out.where("fires").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("first_id"))


@query(
    r"""with o as (select o_orderkey k, [o_orderstatus, case when o_orderkey % 3 = 0 then '' else o_orderpriority end, upper(left(o_orderpriority, 3))] a, lead([case when o_orderkey % 4 = 0 then '' else o_orderstatus end, o_orderpriority || (case when o_orderkey % 5 = 0 then '_' else '' end), 'AB']) over (partition by o_custkey order by o_orderkey) b from orders),
    z as (select k, unnest(range(1, 4)) i, trim(unnest(a)) x, trim(unnest(b)) y from o where b is not null)
    select k as first_id, array_to_string(list(case when x = '' then y when y = '' then x when regexp_matches(x, '[_\-/\\]$') then x || y
      when not contains(x, ' ') and not contains(y, ' ') and x = upper(x) and x <> lower(x) and y = upper(y) and y <> lower(y) and length(y) <= 3 then x || y else x || ' ' || y end order by i), '|') as merged from z group by 1"""
)
def merge_continued_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of neighbouring orders merged as rows that a page break cut."""
    o = table(spark, d, "orders")
    a = F.array("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")), F.upper(F.left("o_orderpriority", F.lit(3))))
    b = F.array(F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderstatus")), F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, "_").otherwise("")), F.lit("AB"))
    df = o.select(F.col("o_orderkey").alias("first_id"), a.alias("a"), F.lead(b).over(scans.ordered("o_custkey", "o_orderkey")).alias("b")).where("b is not null")
    return df.select("first_id", F.array_join(F.zip_with("a", "b", lambda x, y: text.merge_cells(x, y)), "|").alias("merged"))


@query(
    "select n_nationkey, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int as row_index, 'Name = ' || n_name || '; Column 2 = ' || n_regionkey as chunk from nation"
)
def table_row_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Regions as tables of nations, one chunk a row; the second header is blank."""
    from ..operators import chunks

    row = F.array(F.col("n_name"), F.col("n_regionkey").cast("string"))
    t = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("x"))
    t = t.select("x", F.transform("x", lambda x: x["r"]).alias("rows"), F.array(F.lit("Name"), F.lit("")).alias("headers"))
    out = chunks.table_chunks(t)
    return out.select(F.get("x", F.col("row_index"))["n_nationkey"].alias("n_nationkey"), "row_index", "chunk")
