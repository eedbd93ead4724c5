"""A corpus pipeline: quality rules, toxicity, near-duplicates, personal data, packing, in this order.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before kept; all but the last return the
columns of documents. ``run`` writes each stage's rows to the shared folder and reads them again, so a lost executor
repeats part of one stage at most; rows that the next stage has taken up are removed.

The near-duplicate stage groups by the contract of its operator: 4-word shingles, fingerprints within 4 bits. That finds
copies and near copies that differ in few words; pairs of five-word similarity 0.8 mostly lie further apart (see README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import op2_toxicity, op4_simhash, op5_pii, op6_packing, op8_quality
from paperloom.llm.common import dropped, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return op8_quality.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the cut; the classifier learns from labelled documents among those it gets."""
    return op2_toxicity.keep_clean(docs, op2_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates."""
    return op4_simhash.keep_first(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by surrogates."""
    return op5_pii.without_pii(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return op6_packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
#: Learned scores and tokenizer ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
