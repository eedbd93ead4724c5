"""Order, sections and structure over tables that stand for document graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scans
from ..operators import blocks as B
from ..operators import lines as L
from .registry import query, table


@query(
    """with recursive w as (select 'r' || r_regionkey ref, 0 depth, lpad(r_regionkey::varchar, 6, '0') path from region
      union all select case depth when 0 then 'n' || n_nationkey else 's' || s_suppkey end, depth + 1, path || '/' || lpad(coalesce(n_nationkey, s_suppkey % 1000000)::varchar, 6, '0')
      from w left join nation on depth = 0 and ref = 'r' || n_regionkey left join supplier on depth = 1 and ref = 'n' || s_nationkey where coalesce(n_nationkey, s_suppkey) is not null)
    select ref, depth::int as depth, path from w"""
)
def reading_order_walk(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and suppliers as a tree of references, in depth-first order."""
    r = table(spark, d, "region").select(F.lit(None).cast("string").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("ref"), F.col("r_regionkey").alias("pos"))
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("ref"), F.col("n_nationkey").alias("pos"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.concat(F.lit("s"), "s_suppkey").alias("ref"), (F.col("s_suppkey") % 1000000).alias("pos"))
    edges = r.unionByName(n).unionByName(s).withColumn("doc_id", F.lit(1))
    return B.reading_order(edges).select("ref", "depth", "path")


@query(
    """with recursive h as (select l_orderkey o, l_linenumber % 6 + 1 lv, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) i, l_linenumber n, l_partkey p from lineitem),
    r as (select o, i, p, [p] stack from h where i = 1 union all select h.o, h.i, h.p, list_append(list_slice(r.stack, 1, least(len(r.stack), h.lv - 1)), h.p) from r join h on h.o = r.o and h.i = r.i + 1)
    select o as doc_id, i::int as ord, len(stack)::int as depth, array_to_string(stack, '>') as section_path from r"""
)
def section_path_depth(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as headings, parts as their titles; the oracle keeps the stack itself."""
    w = scans.ordered("l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).alias("ord"), F.lit(True).alias("h"), (F.col("l_linenumber") % 6 + 1).cast("int").alias("level"), F.col("l_partkey").cast("string").alias("text"))
    out = scans.section_paths(df, "doc_id", "ord", "h", "level", "text", 8)
    return out.select("doc_id", "ord", "depth", F.array_join("section_path", ">").alias("section_path"))


@query(
    """select event_id, (event_type <> 'error' and sum((event_type = 'error')::int) over (partition by user_id order by event_id) % 2 = 1) as in_fence from events"""
)
def fence_parity(spark: SparkSession, d: str) -> DataFrame:
    """Errors open and close a fence in the events of a user."""
    e = table(spark, d, "events")
    return e.select("event_id", scans.inside_fence(F.col("event_type") == "error", scans.ordered("user_id", "event_id")).alias("in_fence"))


@query(
    """with c as (select l_suppkey s, l_returnflag f, l_linenumber lv, count(*) n from lineitem group by all) select s as doc_id, lower(f) as signature, lv as doc_level from c qualify row_number() over (partition by s, f order by n desc, lv) = 1"""
)
def document_heading_level(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent line number of each flag of a supplier; the smallest on a tie."""
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.lit("section_header").alias("label"), F.col("l_linenumber").alias("level"), F.col("l_returnflag").alias("text"))
    return L.heading_levels(items)


@query(
    """with i as (select l_suppkey doc_id, l_linenumber page, row_number() over (partition by l_suppkey, l_linenumber order by l_orderkey, l_partkey, l_extendedprice) ord, case when l_quantity + 5 < 25 then 'left' else 'right' end s from lineitem),
    c as (select doc_id, page, s, lag(s) over (partition by doc_id, page order by ord) p from i)
    select doc_id, page, sum(coalesce((p <> s)::int, 0))::bigint as switches, sum(coalesce((p <> s)::int, 0)) >= 3 and count(distinct s) = 2 as ambiguous from c group by 1, 2"""
)
def mixed_column_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines as items of pages 50 wide: how often reading order changes sides."""
    items = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.struct("l_orderkey", "l_partkey", "l_extendedprice").alias("ord"), F.col("l_quantity").alias("left"), (F.col("l_quantity") + 10).alias("right"), F.lit(50.0).alias("page_width")
    )
    return B.mixed_column_pages(items)


@query(
    """select l_suppkey as doc_id, case when bool_or(l_returnflag = 'R') then 'section_only' when bool_or(l_returnflag = 'A') then 'page' else 'unavailable' end as provenance_scope from lineitem group by 1"""
)
def provenance_scope(spark: SparkSession, d: str) -> DataFrame:
    from ..plans import gates

    scope = F.when(F.col("l_returnflag") == "R", "section_only").when(F.col("l_returnflag") == "A", "page").otherwise("unavailable")
    return gates.provenance_scope(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), scope.alias("provenance_scope")))


@query(
    """select doc_id, quality + toxic as total, 14 as maximum, case when doc_id % 10 = 0 then 'fields' when doc_id % 10 = 1 then 'range' end as error from (select doc_id, quality, toxic from labels) where doc_id % 10 > 1
    union all select doc_id, null, 14, case when doc_id % 10 = 0 then 'fields' else 'range' end from labels where doc_id % 10 <= 1"""
)
def evaluation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Labels as two of seven scores; some rows lack a field or have one out of range."""
    from ..plans import gates

    lab = table(spark, d, "labels")
    values = [F.col("quality"), F.col("toxic"), *(F.lit(0) for _ in range(4)), F.when(F.col("doc_id") % 10 == 1, 3).otherwise(0)]
    full = F.map_from_arrays(F.array(*(F.lit(s) for s in gates.SCORES)), F.array(*values))
    short = F.map_from_arrays(F.array(*(F.lit(s) for s in gates.SCORES[:6])), F.array(*values[:6]))
    return lab.select("doc_id", gates.evaluation(F.when(F.col("doc_id") % 10 == 0, short).otherwise(full)).alias("e")).select("doc_id", "e.*")
