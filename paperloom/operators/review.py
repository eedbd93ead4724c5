"""Guarded two-pass review: who is asked, what it costs, when it stops, and what its answers are worth.

The model call itself is outside (see plans.reviewer); everything around it is set logic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

KEYWORDS = "architecture|data flow|database|deployment|docker|integration|kubernetes|sequence|service|workflow".split("|")
ERD_MARKERS = "_id| fk| pk|enum|timestamp|uuid|varchar".split("|")
SYSTEMIC = "|".join(["api key not valid", "billing", *(f"error code: {n}" for n in (401, 403, 404, 429)), "invalid api key", "invalid schema", "model not found", "not_found", "permission denied", "quota exceeded", "response schema"])
TRANSIENT = "429|rate|timeout|timed out|temporar|unavailable|503|500|connection"


def score(kind: Column, searchable: Column, ocr_hint: Column) -> Column:
    low = text.casefold(F.coalesce(searchable, F.lit("")))
    hits = sum(low.contains(k).cast("int") for k in KEYWORDS)
    return F.when(kind != "diagram", 100).otherwise(0) + 15 * hits + F.least(F.lit(20), F.floor(F.length(F.coalesce(ocr_hint, F.lit(""))) / 80)).cast("int")


def select(candidates: DataFrame, limit: int, group: list[str]) -> DataFrame:
    """Adds rank, selected and reason: the best ``limit`` candidates of a group, one for each piece of evidence.

    ``candidates``: candidate_id, score, evidence (null or empty: always its own). A candidate whose evidence a selected
    one holds is duplicate_evidence, the others are candidate_limit.
    """
    suffix = F.regexp_extract("candidate_id", r"-(\d+)$", 1)
    order = [F.col("score").desc(), F.when(suffix != "", suffix.cast("long")).otherwise(0), F.col("candidate_id")]
    key = F.when(F.coalesce("evidence", F.lit("")) == "", F.concat(F.lit("\u0001"), "candidate_id")).otherwise(F.col("evidence"))
    df = candidates.withColumn("_key", key)
    df = df.withColumn("_first", F.row_number().over(Window.partitionBy(*group, "_key").orderBy(*order)) == 1)
    w = Window.partitionBy(*group).orderBy(*order)
    df = df.withColumn("rank", F.row_number().over(w))
    df = df.withColumn("selected", F.col("_first") & (F.sum(F.col("_first").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= limit))
    held = F.max("selected").over(Window.partitionBy(*group, "_key"))
    reason = F.when(F.col("selected"), None).when(held, "duplicate_evidence").otherwise("candidate_limit")
    return df.withColumn("reason", reason).drop("_key", "_first")


def select_run(candidates: DataFrame, limit: int) -> DataFrame:
    """As select() for one group of all candidates of a corpus: nothing is sorted or windowed as a whole.

    The best candidate of each piece of evidence is an aggregate with map-side combining, the best ``limit`` of these a
    top-k; they are few, so they are broadcast back. Only selected candidates have a rank, 1 to ``limit``. Candidates of two
    documents are never one, whatever their ids.
    """
    suffix = F.regexp_extract("candidate_id", r"-(\d+)$", 1)
    turn = F.struct((-F.col("score")).alias("a"), F.when(suffix != "", suffix.cast("long")).otherwise(0).alias("b"), F.col("candidate_id").alias("c"), F.col("doc_id").cast("string").alias("d"))
    own = F.concat_ws("\u0001", F.lit(""), F.col("doc_id").cast("string"), "candidate_id")
    df = candidates.withColumn("_key", F.when(F.coalesce("evidence", F.lit("")) == "", own).otherwise(F.col("evidence"))).withColumn("_turn", turn)
    best = df.groupBy("_key").agg(F.min("_turn").alias("_best")).orderBy("_best").limit(limit)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy("_best")))  # of at most ``limit`` rows
    df = df.join(F.broadcast(best), "_key", "left")
    selected = F.coalesce(F.col("_turn") == F.col("_best"), F.lit(False))
    reason = F.when(selected, None).when(F.col("_best").isNotNull(), "duplicate_evidence").otherwise("candidate_limit")
    return df.withColumns({"selected": selected, "reason": reason, "rank": F.when(selected, F.col("rank"))}).drop("_key", "_turn", "_best")


def cost(input_tokens: Column, output_tokens: Column, thought_tokens: Column, price_in: float, price_out: float, rate: float) -> Column:
    return (input_tokens * price_in + (output_tokens + thought_tokens) * price_out) / 1e6 * rate


def guard(requests: DataFrame, run: str, order: str, max_requests: int, max_tokens: int, budget: float, reserve: float, max_seconds: float | None = None) -> DataFrame:
    """Adds spent, tokens (both before the request) and stop: why a request is not made; after the first stop none is.

    ``requests``: tokens, cost and, with ``max_seconds``, elapsed. Requests before the first stop all run, so sums over
    all earlier rows are exact up to it, and what follows is latched.
    """
    w = Window.partitionBy(run).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = requests.withColumns(
        {"spent": F.coalesce(F.sum("cost").over(before), F.lit(0.0)), "used": F.coalesce(F.sum("tokens").over(before), F.lit(0)), "made": (F.row_number().over(w) - 1)}
    )
    why = F.when(F.col("elapsed") >= max_seconds, "runtime_limit") if max_seconds is not None else F.when(F.lit(False), "runtime_limit")
    why = (
        why.when(F.col("made") >= max_requests, "request_limit")
        .when(F.col("used") >= max_tokens, "token_limit")
        .when(F.col("spent") >= budget, "budget_limit")
        .when((F.col("made") > 0) & (F.lit(budget) - F.col("spent") < reserve), "budget_reserve")
    )
    df = df.withColumn("_why", why)
    return df.withColumn("stop", F.first("_why", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_why", "made")


def is_systemic(error: Column) -> Column:
    return F.coalesce(text.casefold(error).rlike(SYSTEMIC), F.lit(False))


def is_transient(error: Column) -> Column:
    return F.coalesce(F.lower(error).rlike(TRANSIENT), F.lit(False))


def circuit(calls: DataFrame, run: str, order: str) -> DataFrame:
    """Adds attempted: false once an earlier call of the run failed in a way that makes every other call useless."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("attempted", ~F.coalesce(F.max(is_systemic(F.col("error"))).over(w), F.lit(False)))


def valid_extraction(claims: Column) -> Column:
    """Claim ids are unique and every claim has evidence. ``claims``: array of struct(id, evidence)."""
    return (F.size(F.array_distinct(F.transform(claims, lambda c: c["id"]))) == F.size(claims)) & F.forall(claims, lambda c: F.size(c["evidence"]) > 0)


def valid_verification(claim_ids: Column, verdicts: Column) -> Column:
    """Verdicts cover exactly the claims, and verified ones have evidence. ``verdicts``: array of struct(claim_id, verdict, evidence)."""
    own = F.array_sort(F.array_distinct(F.transform(verdicts, lambda v: v["claim_id"])))
    same = (own == F.array_sort(F.array_distinct(claim_ids))) & (F.size(own) == F.size(verdicts))
    return same & F.forall(verdicts, lambda v: (v["verdict"] != "verified") | (F.size(v["evidence"]) > 0))


def valid_regions(regions: Column, evidence_count: Column) -> Column:
    """Regions name existing evidence; boxes are empty or y0, x0, y1, x1 within 0..1000 in order."""
    box = lambda b: (F.size(b) == 0) | ((F.size(b) == 4) & F.forall(b, lambda v: v.between(0, 1000)) & (F.get(b, F.lit(0)) <= F.get(b, F.lit(2))) & (F.get(b, F.lit(1)) <= F.get(b, F.lit(3))))
    return F.forall(regions, lambda r: (r["index"] >= 0) & (r["index"] < evidence_count) & box(r["box"]))


def result_status(n_claims: Column, n_verified: Column) -> Column:
    return F.when((n_claims == 0) | (n_verified == 0), "unresolved").when(n_verified == n_claims, "verified").otherwise("partial")


def supplements(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verified claims; a corrected statement takes the place of the extracted one."""
    v = verdicts.where("verdict = 'verified'").select("doc_id", "candidate_id", "claim_id", "corrected_statement")
    return claims.join(v, ["doc_id", "candidate_id", "claim_id"]).withColumn("statement", F.coalesce(F.nullif(text.strip(F.col("corrected_statement")), F.lit("")), F.col("statement"))).drop("corrected_statement")


def overlay(blocks: DataFrame, overlays: DataFrame) -> DataFrame:
    """Blocks with verified corrections (doc_id, block_id, new_type, new_level) applied; pictures stay as they are."""
    df = blocks.join(overlays, ["doc_id", "block_id"], "left")
    hit = F.col("new_type").isNotNull() & (F.col("block_type") != "picture")
    return df.withColumns(
        {
            "integrity_status": F.when(hit, "ai_verified").otherwise(F.col("integrity_status")),
            "level": F.when(hit & (F.col("new_type") == "heading"), F.greatest(F.lit(1), F.least(F.coalesce("new_level", "level", F.lit(1)), F.lit(6)))).otherwise(F.col("level")),
            "block_type": F.when(hit, F.col("new_type")).otherwise(F.col("block_type")),
        }
    ).drop("new_type", "new_level")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def tiles(width: Column, height: Column, hint: Column) -> Column:
    """struct(strategy, boxes of x0, y0, x1, y1): how evidence is cut so that a model can read it."""
    long, short = F.greatest(width, height), F.greatest(F.least(width, height), F.lit(1))
    low = F.lower(F.coalesce(hint, F.lit("")))
    erd = (width.cast("long") * height >= 1_500_000) & (sum(low.contains(m).cast("int") for m in ERD_MARKERS) >= 2)
    wide = (long >= 4096) & (long / short >= 4)
    full = F.array(F.lit(0), F.lit(0), width, height)

    def cut(n: Column, overlap: Column, upright: Column) -> Column:
        def box(i: Column) -> Column:
            a = F.greatest(F.lit(0), F.floor(i * long / n).cast("int") - F.when(i > 0, overlap).otherwise(0))
            z = F.least(long, F.floor((i + 1) * long / n).cast("int") + F.when(i + 1 < n, overlap).otherwise(0))
            return F.when(upright, F.array(F.lit(0), a, width, z)).otherwise(F.array(a, F.lit(0), z, height))

        return F.transform(F.sequence(F.lit(0), n - 1), box)

    count = F.least(F.lit(4), F.greatest(F.lit(2), F.bround(long / (short * 3)).cast("int")))
    return (
        F.when(erd, F.struct(F.lit("full_plus_erd_tiles").alias("strategy"), F.concat(F.array(full), cut(F.lit(2), F.greatest(F.lit(24), F.floor(long * 0.03).cast("int")), height >= width)).alias("boxes")))
        .when(wide, F.struct(F.lit("tiled_extreme_aspect").alias("strategy"), cut(count, F.greatest(F.lit(16), F.floor(long * 0.02).cast("int")), height > width).alias("boxes")))
        .otherwise(F.struct(F.lit("single_image").alias("strategy"), F.array(full).alias("boxes")))
    )
