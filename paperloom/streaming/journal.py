"""The review journal as a stream: an append-only log of JSON lines, folded key by key into the latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "run_id string, sequence long, timestamp string, event string, phase string, candidate_id string, requests long, total_tokens long, spent double, status string"
STATE = ["phase", "candidate_id", "requests", "total_tokens", "spent", "status"]


def read_journal(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """Events of JSON-lines files; lines that are not events are left out."""
    reader = spark.readStream if stream else spark.read
    lines = reader.text(path)
    return lines.select(F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE"}).alias("e")).where("e.sequence is not null").select("e.*")


def fold(events: DataFrame, key: str = "run_id", order: str = "sequence", columns: list[str] | None = None) -> DataFrame:
    """Latest value of each column that an event carried, for each key: batch or stream (update mode)."""
    columns = columns or STATE
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return events.groupBy(key).agg(F.max(order).alias(f"last_{order}"), F.count(F.lit(1)).alias("n_events"), *latest)


def event_rows(events: DataFrame, currency: str = "") -> DataFrame:
    """Journal events as the 18 columns of a table to look at; what an event doesn't carry is blank, counters are zero.

    Columns that ``events`` lacks count as absent. Amounts have two digits, seconds one.
    """
    has = {c: F.col(c) for c in events.columns}
    get = lambda c, kind="string": has.get(c, F.lit(None)).cast(kind)
    number = lambda c, kind="long": F.coalesce(get(c, kind), F.lit(0).cast(kind))
    money = lambda c: F.concat(F.lit(currency), F.format_string("%.2f", number(c, "double")))
    return events.select(
        get("sequence", "long").alias("no"), F.substring(get("timestamp"), 12, 8).alias("time"), get("event").alias("event"), get("candidate_id").alias("candidate"), get("stage").alias("stage"), get("attempt", "long").alias("attempt"),
        F.concat_ws("/", number("requests"), number("requests_limit")).alias("calls"), number("diagram_requests").alias("diagram_passes"), get("evidence_count", "long").alias("evidence_files"), get("request_tokens", "long").alias("request_tokens"),
        get("response_status").alias("response"), get("error_type").alias("error"), number("total_tokens").alias("total_tokens"), number("thought_tokens").alias("thinking"), money("spent").alias("spend"), money("remaining").alias("remaining"),
        F.format_string("%.1fs", number("elapsed_seconds", "double")).alias("elapsed"), get("message").alias("message"),
    )


def windowed(events: DataFrame, time: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts by event-time window with a watermark: an extension, as the journal's own order is its sequence."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n_events"))


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run a fold as a stream over all that is there: each micro-batch writes the keys it changed; ends by itself.

    A batch that is run again writes its own folder again, so nothing is there twice.
    """

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """State of each key in what run_to_files() wrote: that of the last batch that changed it."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("s.*")
