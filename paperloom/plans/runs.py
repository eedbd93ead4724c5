"""Runs: manifest, stage timings, progress, evaluation files and archives. Driver-side bookkeeping of a few rows."""

from __future__ import annotations

import io
import json
import math
import time
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime
from importlib import metadata
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gates

Progress = Callable[[dict[str, Any]], None]
PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")


def version(package: str) -> str | None:
    try:
        return metadata.version(package)
    except metadata.PackageNotFoundError:
        return None


def notify(callback: Progress | None, event: dict[str, Any]) -> None:
    """A callback that fails never stops a run."""
    if callback is not None:
        try:
            callback(event)
        except Exception:  # noqa: BLE001
            pass


@dataclass
class Timings:
    """Outcome and seconds of named stages, in order."""

    stages: dict[str, dict[str, Any]] = field(default_factory=dict)
    callback: Progress | None = None

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began, status = time.perf_counter(), "failed"
        notify(self.callback, {"event": "stage_started", "stage": name})
        try:
            yield
            status = "ran"
        finally:
            self.stages[name] = {"status": status, "seconds": round(time.perf_counter() - began, 6)}
            notify(self.callback, {"event": "stage_finished", "stage": name, **self.stages[name]})

    def skip(self, name: str, reason: str) -> None:
        self.stages[name] = {"status": "skipped", "seconds": 0.0, "reason": reason}


def manifest(source: dict[str, Any], profile: dict[str, Any], status: str = "running", **more: Any) -> dict[str, Any]:
    return {
        "status": status,
        "created_at": datetime.now(UTC).isoformat(),
        "schema_version": "1.0",
        "source": source,
        "profile": profile,
        "runtime": {p: version(p) for p in PACKAGES},
        "counts": {},
        "warnings": [],
        "stage_timings": {},
        **more,
    }


def finished(m: dict[str, Any], timings: Timings, counts: dict[str, int], warnings: list[str]) -> dict[str, Any]:
    """A manifest after its run: failed if a stage failed, partial_success with warnings."""
    failed = any(s["status"] == "failed" for s in timings.stages.values())
    return {**m, "status": "failed" if failed else "partial_success" if warnings else "success", "counts": counts, "warnings": warnings, "stage_timings": timings.stages}


def json_safe(value: Any) -> Any:
    """Without numbers that JSON lacks."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [json_safe(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_json(path: Path, value: Any) -> None:
    path.write_text(json.dumps(json_safe(value), ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def manifest_frame(spark: SparkSession, manifests: list[dict[str, Any]]) -> DataFrame:
    """Manifests as rows: run status and readiness in columns, the rest as JSON."""
    rows = [(m["source"].get("path"), m["status"], m["created_at"], json.dumps(json_safe(m))) for m in manifests]
    return spark.createDataFrame(rows, "path string, status string, created_at string, manifest string")


def new_evaluation(folder: Path) -> Path:
    path = folder / "evaluation.json"
    write_json(path, {"status": "pending", "scores": dict.fromkeys(gates.SCORES), "total": None, "maximum": 2 * len(gates.SCORES), "notes": ""})
    return path


def save_evaluation(folder: Path, scores: dict[str, int], remark: str = "") -> Path:
    """Exactly the seven scores, each 0, 1 or 2."""
    if set(scores) != set(gates.SCORES):
        raise ValueError("scores must be exactly: " + ", ".join(gates.SCORES))
    if any(type(v) is not int or v not in (0, 1, 2) for v in scores.values()):
        raise ValueError("scores must be 0, 1 or 2")
    path = folder / "evaluation.json"
    write_json(path, {"status": "complete", "maximum": 2 * len(gates.SCORES), "total": sum(scores.values()), "notes": remark, "scores": scores})
    return path


def archive(folder: Path) -> bytes:
    """The files of a run folder as a ZIP."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(folder.rglob("*")):
            if p.is_file():
                z.write(p, p.relative_to(folder))
    return out.getvalue()


def read_json(path: str | Path) -> Any:
    """What write_json() wrote."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


def without_page_images(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, length) of a run without its page pictures, and (n_files, n_bytes) of those."""
    page = F.col("path").rlike(r"(?:^|/)assets/page_[^/]*$")
    return files.where(~page), files.where(page).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def preview(text: str, limit: int = 250_000) -> tuple[str, bool]:
    """The beginning of a text and whether there is more."""
    return text[:limit], len(text) > limit


def page_metric(df: DataFrame) -> DataFrame:
    """Adds pages_shown: the page count, or Unavailable for .docx files without one."""
    unknown = (F.col("extension") == ".docx") & (F.coalesce("n_pages", F.lit(0)) == 0)
    return df.withColumn("pages_shown", F.when(unknown, "Unavailable").otherwise(F.coalesce("n_pages", F.lit(0)).cast("string")))
