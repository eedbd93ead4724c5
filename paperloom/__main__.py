"""Command line: ``python -m paperloom parse FILE | batch FOLDER [--output FOLDER] [--profile NAME]``.

Text, Markdown, web pages, DOCX files and document graphs are run, one plan a format; the exit code is 1 if any file was
turned away or needs a converter (PDF, pictures, slides).
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import documents, runs, settings
from .sources import files, readers

TEXT, WEB = [".md", ".markdown", ".txt"], [".html", ".htm"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="paperloom")
    p.add_argument("command", choices=["parse", "batch"])
    p.add_argument("path")
    p.add_argument("--output", default="output")
    p.add_argument("--profile", default="standard", choices=settings.PROFILES)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("paperloom").getOrCreate()
    profile = settings.profile(a.profile)
    out = Path(a.output)
    timings = runs.Timings(callback=lambda e: print(e["event"], e["stage"], file=sys.stderr))
    folder = a.path if a.command == "batch" else str(Path(a.path).parent)
    with timings.stage("validate"):
        found = files.check_office(files.validated(files.read_files(spark, folder), profile.max_bytes))
        if a.command == "parse":
            found = found.where(F.col("path").endswith("/" + Path(a.path).name))
        found.select("path", "safe_stem", "sha256", "length", "mime", "error").write.mode("overwrite").parquet(f"{out}/inputs")
        inputs = spark.read.parquet(f"{out}/inputs")
        n_files, n_bad = (r := inputs.agg(F.count(F.lit(1)), F.count_if(F.col("error").isNotNull())).first())[0], r[1]
    counts = {"files": n_files, "rejected": n_bad, "clean_chunks": 0}
    good = found.where("error is null")
    text = F.decode("content", "UTF-8")
    plans = {
        "text": (TEXT, lambda df: documents.run_markdown(df.select(F.col("path").alias("doc_id"), text.alias("text")))),
        "web": (WEB, lambda df: documents.run_html(df.select(F.col("path").alias("doc_id"), text.alias("html")))),
        "docx": ([".docx"], documents.run_docx),
    }
    kinds = {r.extension: r.n for r in good.groupBy("extension").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row an extension
    for kind, (endings, plan) in plans.items():
        if not any(e in kinds for e in endings):
            timings.skip(kind, "no such file")
            continue
        with timings.stage(kind):
            result = plan(good.where(F.col("extension").isin(endings)))
            for name in ("clean_chunks", "core_chunks", "review_queue", "gates"):
                getattr(result, name).write.mode("overwrite").json(f"{out}/{kind}/{name}")
            chunks = spark.read.schema(result.clean_chunks.schema).json(f"{out}/{kind}/clean_chunks")
            counts["clean_chunks"] += chunks.count()
    # formats that only an outside converter reads are named, not counted as done
    counts["not_converted"] = sum(n for e, n in kinds.items() if not any(e in endings for endings, _ in plans.values()))
    warnings = [f"{n_bad} files rejected"] * (n_bad > 0) + [f"{counts['not_converted']} files need a converter"] * (counts["not_converted"] > 0)
    if a.command == "batch" and any(Path(a.path).glob("*.json")):
        with timings.stage("graphs"):
            graphs = documents.run_graphs(readers.read_graphs(spark, f"{a.path}/*.json"))
            graphs.clean_chunks.write.mode("overwrite").json(f"{out}/graph_clean_chunks")
    m = runs.finished(runs.manifest({"path": a.path}, profile.to_dict()), timings, counts, warnings)
    runs.write_json(out / "manifest.json", m)
    print(f"{m['status']}: {counts}")
    return int(n_bad > 0 or n_files == 0 or counts["not_converted"] > 0)


if __name__ == "__main__":
    sys.exit(main())
