"""Guarded review and pictures over events, parts and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunks, pictures, review
from ..plans import stage
from ..streaming import journal
from .registry import query, table

_HITS = " + ".join(f"(s like '%{k}%')::int" for k in review.KEYWORDS)


@query(
    rf"""with d as (select doc_id, source, text, replace(lower(text), 'ß', 'ss') s, 'ai-' || lpad(doc_id::varchar, 4, '0') cid, case when lang = 'en' then 'diagram' else 'structural_ambiguity' end kind, case when doc_id % 5 = 0 then '' else md5(string_split(text, chr(10))[1]) end ev from documents),
    c as (select *, (case when kind <> 'diagram' then 100 else 0 end + 15 * ({_HITS}) + least(20, length(text) // 80))::int sc, case when ev = '' then cid else ev end k from d),
    f as (select *, row_number() over (partition by source, k order by sc desc, doc_id, cid) = 1 fst, row_number() over (partition by source order by sc desc, doc_id, cid) rnk from c),
    g as (select *, fst and sum(fst::int) over (partition by source order by sc desc, doc_id, cid) <= 5 sel from f)
    select doc_id, sc as score, rnk::int as rank, sel as selected, case when sel then null when bool_or(sel) over (partition by source, k) then 'duplicate_evidence' else 'candidate_limit' end as reason from g"""
)
def candidate_selection(spark: SparkSession, d: str) -> DataFrame:
    """Documents as candidates of their source; equal first lines are one piece of evidence."""
    docs = table(spark, d, "documents")
    kind = F.when(F.col("lang") == "en", "diagram").otherwise("structural_ambiguity")
    evidence = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.md5(F.get(F.split("text", "\n"), F.lit(0))))
    cid = F.concat(F.lit("ai-"), F.when(F.length(F.col("doc_id").cast("string")) < 4, F.lpad(F.col("doc_id").cast("string"), 4, "0")).otherwise(F.left(F.col("doc_id").cast("string"), F.lit(4))))
    c = docs.select("doc_id", "source", cid.alias("_c"), F.concat(F.lit("ai-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("candidate_id"), review.score(kind, F.col("text"), F.col("text")).alias("score"), evidence.alias("evidence"))
    return review.select(c, 5, ["source"]).select("doc_id", "score", "rank", "selected", "reason")


@query(
    """with e as (select user_id, event_id, value, sum(value) over w spent, sum(100) over w used, row_number() over (partition by user_id order by event_id) - 1 made from events window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)),
    f as (select *, case when made >= 40 then 'request_limit' when coalesce(used, 0) >= 3000 then 'token_limit' when coalesce(spent, 0) >= 1500 then 'budget_limit' when made > 0 and 1500 - coalesce(spent, 0) < 100 then 'budget_reserve' end why from e)
    select event_id, round(coalesce(spent, 0), 4) as spent, first_value(why ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as stop from f"""
)
def budget_guard(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as requests that cost their value."""
    e = table(spark, d, "events").select("user_id", "event_id", F.lit(100).alias("tokens"), F.col("value").alias("cost"))
    out = review.guard(e, "user_id", "event_id", max_requests=40, max_tokens=3000, budget=1500.0, reserve=100.0)
    return out.select("event_id", F.round("spent", 4).alias("spent"), "stop")


@query(
    "select event_id, not coalesce(bool_or(event_type = 'error' and event_id % 3 = 0) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), false) as attempted from events"
)
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Every third error of a user is one that no retry can mend."""
    error = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, "Error code: 404 model not_found").otherwise("bad JSON"))
    return review.circuit(table(spark, d, "events").select("user_id", "event_id", error.alias("error")), "user_id", "event_id").select("event_id", "attempted")


@query(
    """with g as (select user_id, list_sort(list_distinct(list(event_type))) claims, list(event_type order by event_id) first_types from events group by 1),
    v as (select user_id, list_distinct(list_slice(first_types, 1, 8)) v, claims from g)
    select user_id, len(claims)::int as n_claims, list_sort(v) = claims and not list_contains(v, 'error') as valid from v"""
)
def claim_verdict_validation(spark: SparkSession, d: str) -> DataFrame:
    """Event types of a user as claims, those among the first eight events as verdicts; an error's verdict has no evidence."""
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("claims"), F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    seen = F.array_distinct(F.transform(F.slice("x", 1, 8), lambda x: x["event_type"]))
    none = F.array().cast("array<int>")
    verdicts = F.transform(seen, lambda t: F.struct(t.alias("claim_id"), F.lit("verified").alias("verdict"), F.when(t == "error", none).otherwise(F.array(F.lit(0))).alias("evidence")))
    return g.select("user_id", F.size("claims").alias("n_claims"), review.valid_verification(F.col("claims"), verdicts).alias("valid"))


@query(
    """with p as (select p_partkey, (p_size * 110)::int w, (p_partkey % 1500 + 100)::int h, p_partkey % 2 = 0 erd from part), q as (select *, greatest(w, h) lo, greatest(1, least(w, h)) sh from p)
    select p_partkey, case when w::bigint * h >= 1500000 and erd then 'full_plus_erd_tiles' when lo >= 4096 and lo / sh >= 4 then 'tiled_extreme_aspect' else 'single_image' end as strategy,
      case when w::bigint * h >= 1500000 and erd then 3 when lo >= 4096 and lo / sh >= 4 then least(4, greatest(2, round_even(lo / (sh * 3), 0)))::int else 1 end as n_files from q"""
)
def evidence_tiles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    hint = F.when(F.col("p_partkey") % 2 == 0, "users pk, owner_id uuid")
    t = review.tiles((F.col("p_size") * 110).cast("int"), (F.col("p_partkey") % 1500 + 100).cast("int"), hint)
    return p.select("p_partkey", t.alias("t")).select("p_partkey", "t.strategy", F.size("t.boxes").alias("n_files"))


@query(
    """with p as (select p_partkey, p_partkey // 100 doc, p_size * 20 w, (p_partkey % 700 + 1) h, p_partkey % 7 = 0 st, p_partkey % 11 <> 0 fl, p_partkey % 13 <> 0 mt, case p_partkey % 5 when 0 then null when 1 then 'failed' when 2 then 'timeout' else 'done' end os, case p_partkey % 6 when 3 then '' else p_name end tx from part),
    q as (select *, w * h >= 35000 and least(w, h) >= 50 ql from p), r as (select *, sum((ql and not st and fl and mt)::int) over (partition by doc order by p_partkey) tn from q),
    t as (select *, regexp_extract_all(tx, '[A-Za-z0-9]+') k from r)
    select p_partkey, case when st and not fl then 'missing_exported_asset' when st then 'structured_text' when not ql then 'below_threshold' when not fl then 'missing_exported_asset' when not mt then 'unmatched_source_reference' when tn > 40 then 'ocr_limit_exceeded'
      when os is null then 'ocr_unavailable' when os = 'timeout' then 'ocr_timeout' when os = 'failed' then 'ocr_failed' when trim(tx) = '' then 'ocr_empty'
      when length(replace(tx, ' ', '')) >= 12 and len(list_filter(k, lambda v: length(v) >= 3)) >= 2 and len(list_distinct(list_transform(list_filter(k, lambda v: length(v) >= 3), lambda v: lower(v)))) >= 2 and len(list_filter(k, lambda v: length(v) >= 5)) > 0 and len(list_filter(k, lambda v: length(v) < 3)) <= 1.5 * len(list_filter(k, lambda v: length(v) >= 3)) then 'ocr_text' else 'ocr_low_quality' end as coverage_status from t"""
)
def coverage_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Parts as pictures, a hundred to a document."""
    k = F.col("p_partkey")
    os = F.when(k % 5 == 1, "failed").when(k % 5 == 2, "timeout").when(k % 5 > 2, "done")
    p = table(spark, d, "part").select(
        "p_partkey", F.floor(k / 100).alias("doc_id"), k.alias("pic_idx"), (F.col("p_size") * 20).alias("width"), (k % 700 + 1).alias("height"), (k % 7 == 0).alias("structured"), (k % 11 != 0).alias("has_file"), (k % 13 != 0).alias("matched"), os.alias("ocr_status"), F.when(k % 6 == 3, "").otherwise(F.col("p_name")).alias("ocr_text")
    )
    return pictures.coverage(p).select("p_partkey", "coverage_status")


@query(
    """select 'ai-' || d.doc_id as candidate_id, case when l.doc_id is null then 'not_reviewed' when toxic = 1 then 'failed' else 'partial' end as status, case when l.doc_id is null then 'review_by_hand' when toxic = 1 then 'retry_or_review_by_hand' else 'confirm_open_claims' end as recommended_action,
    row_number() over (partition by source order by 'ai-' || d.doc_id)::int as turn from documents d left join labels l using (doc_id) where l.doc_id is null or not (quality = 1 and toxic = 0)"""
)
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Documents as candidates of their source, labels as results: good ones are verified and leave the queue."""
    docs = table(spark, d, "documents")
    c = docs.select(F.col("source").alias("doc_id"), F.concat(F.lit("ai-"), "doc_id").alias("candidate_id"), F.lit("diagram").alias("kind"), F.concat(F.lit("b"), "doc_id").alias("block_id"))
    s = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "verified").otherwise("partial")
    r = table(spark, d, "labels").join(docs.select("doc_id", "source"), "doc_id").select(F.col("source").alias("doc_id"), F.concat(F.lit("ai-"), "doc_id").alias("candidate_id"), s.alias("status"))
    b = docs.select(F.col("source").alias("doc_id"), F.concat(F.lit("b"), "doc_id").alias("block_id"), F.lit("picture").alias("block_type"), F.array().cast("array<string>").alias("section_path"))
    return chunks.review_queue(c, r, b).select("candidate_id", "status", "recommended_action", F.regexp_extract("review_id", r"(\d+)$", 1).cast("int").alias("turn"))


@query(
    """select 'text' as kind, doc_id::varchar as ref from documents where doc_id in (select doc_id from labels where quality = 0) union all select 'finding', doc_id::varchar from labels where toxic = 1 and doc_id not in (select doc_id from documents where lang = 'en')"""
)
def candidates_union(spark: SparkSession, d: str) -> DataFrame:
    """Unclear documents, and findings on what no English document holds (an anti-join)."""
    docs, lab = table(spark, d, "documents"), table(spark, d, "labels")
    a = docs.join(lab.where("quality = 0").select("doc_id"), "doc_id", "left_semi").select(F.lit("text").alias("kind"), F.col("doc_id").cast("string").alias("ref"))
    b = lab.where("toxic = 1").join(docs.where("lang = 'en'").select("doc_id"), "doc_id", "left_anti").select(F.lit("finding").alias("kind"), F.col("doc_id").cast("string").alias("ref"))
    return a.unionByName(b)


_FOLD_SQL = """select user_id, max(event_id) as last_event_id, count(*)::bigint as n_events, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) filter (where event_type = 'purchase') as purchase_value from events group by 1"""


def _journal(e: DataFrame) -> DataFrame:
    e = e.select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "purchase", F.col("value")).alias("purchase_value"))
    return journal.fold(e, "user_id", "event_id", ["event_type", "purchase_value"])


@query(_FOLD_SQL)
def journal_state_fold(spark: SparkSession, d: str) -> DataFrame:
    return _journal(table(spark, d, "events"))


@query(_FOLD_SQL)
def journal_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same fold as a stream over the events file, run to its end."""
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parque[t]")
    place = f"{stage.shared_dir(spark)}/journal-{uuid.uuid4().hex}"
    journal.run_to_files(_journal(source), f"{place}/out", f"{place}/checkpoint")
    return journal.latest(spark, f"{place}/out", "user_id")
