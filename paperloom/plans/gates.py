"""Run records: counts, provenance, evaluation scores and readiness gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = ["heading_structure", "reading_order", "table_quality", "picture_text", "chunk_quality", "provenance", "overall"]


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows); each count is answered by file footers where it can be."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("table_name")).groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rows")) for name, df in tables.items()))


def provenance_scope(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """section_only if any chunk is, else page, else unavailable."""
    weight = F.when(F.col("provenance_scope") == "section_only", 2).when(F.col("provenance_scope") == "page", 1).otherwise(0)
    return chunks.groupBy(doc).agg(F.max_by("provenance_scope", weight).alias("provenance_scope"))


def chunk_scope(pages: Column, headings: Column) -> Column:
    return F.when(F.size(pages) > 0, "page").when(F.size(headings) > 0, "section_only").otherwise("unavailable")


def evaluation(scores: Column) -> Column:
    """struct(total, maximum, error) of a map of scores: exactly the seven fields, each 0, 1 or 2."""
    names = F.array(*(F.lit(s) for s in SCORES))
    wrong = (F.size(F.array_except(F.map_keys(scores), names)) > 0) | (F.size(F.array_except(names, F.map_keys(scores))) > 0)
    error = F.when(wrong, "fields").when(~F.forall(F.map_values(scores), lambda v: v.isin(0, 1, 2)), "range")
    total = F.aggregate(F.map_values(scores), F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0)))
    return F.struct(F.when(error.isNull(), total).alias("total"), F.lit(2 * len(SCORES)).alias("maximum"), error.alias("error"))


def gates(report: DataFrame, clean: DataFrame, pictures: DataFrame | None = None) -> DataFrame:
    """The three readiness gates of each document: integrity, pictures (text read by OCR is of low trust and doesn't pass), clean feed."""
    df = clean.join(report.select("doc_id", F.col("readiness").alias("integrity_readiness")), "doc_id", "left")
    if pictures is not None:
        open_ = pictures.where(F.col("qualifying") & (F.col("coverage_status") != "structured_text")).select("doc_id").distinct()
        df = df.join(open_.withColumn("_o", F.lit(True)), "doc_id", "left").withColumn("visual_readiness", F.when(F.col("_o"), "review_required").otherwise("ready")).drop("_o")
    else:
        df = df.withColumn("visual_readiness", F.lit("ready"))
    return df.withColumn("integrity_readiness", F.coalesce("integrity_readiness", F.lit("ready")))
