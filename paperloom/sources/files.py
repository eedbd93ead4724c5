"""Files: validation, digests, office containers and the JSON and text formats that go in and out.

``files`` are rows of ``spark.read.format("binaryFile")`` (path, length, content) or of the same shape. Bad files get an
``error``; nothing is raised for one row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import text

_KINDS = {"image": "bmp jpeg jpg png tif tiff webp", "office": "docx pptx", "text": "markdown md txt", "web": "htm html", "pdf": "pdf"}
EXTENSIONS = [f".{e}" for kind in _KINDS.values() for e in kind.split()]
MAX_SIZE = 100 * 1024 * 1024
IMAGES = [f".{e}" for e in _KINDS["image"].split()]


def read_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Files of a folder with a known extension. Spark's reader leaves out files of no bytes; the listing adds them."""
    pattern = "*.{" + ",".join(e[1:] for e in EXTENSIONS) + "}"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listing = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, recursive)
    empty = []
    while listing.hasNext():
        status = listing.next()
        path = status.getPath().toString()
        if status.getLen() == 0 and any(path.lower().endswith(e) for e in EXTENSIONS):
            empty.append((path, datetime.fromtimestamp(status.getModificationTime() / 1000), 0, bytearray()))
    return found.unionByName(spark.createDataFrame(empty, found.schema)) if empty else found


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def mime_matches(ext: Column, mime: Column, content: Column) -> Column:
    is_text = F.is_valid_utf8(content.cast("string")) & ~F.contains(content.cast("string"), F.lit("\x00"))
    return (
        F.when(ext == ".pdf", mime == "application/pdf")
        .when(ext.isin(".docx", ".pptx"), mime == "application/zip")
        .when(ext.isin(".md", ".markdown", ".txt"), is_text)
        .when(ext.isin(".html", ".htm"), mime.isin("text/plain", "text/html", "application/xhtml+xml") & is_text)
        .when(ext.isin(IMAGES), mime.startswith("image/"))
        .otherwise(False)
    )


def validated(files: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """``files`` with safe_stem, extension, mime, sha256 and error (null: accepted).

    Checks in order: extension, empty, size, content against extension. Office containers are opened afterwards, by
    check_office, for those that passed.
    """
    df = files.withColumns({"extension": extension(F.col("path")), "safe_stem": text.sanitize_stem(F.col("path"))})
    df = df.withColumn("mime", text.mime_by_signature(F.col("content")))
    error = (
        F.when(~F.col("extension").isin(EXTENSIONS), "unsupported_extension")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > max_size, "too_large")
        .when(~F.coalesce(mime_matches(F.col("extension"), F.col("mime"), F.col("content")), F.lit(False)), "content_mismatch")
    )
    return df.withColumns({"error": error, "sha256": F.sha2("content", 256)})


def check_office(files: DataFrame) -> DataFrame:
    """Accepted .docx and .pptx files whose container lacks its main folder get an error."""

    @F.pandas_udf(BooleanType())
    def intact(content: pd.Series, ext: pd.Series) -> pd.Series:
        def one(c: bytes, e: str) -> bool:
            try:
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    return any(n.startswith("word/" if e == ".docx" else "ppt/") for n in z.namelist())
            except zipfile.BadZipFile:
                return False

        return pd.Series([one(c, e) for c, e in zip(content, ext)])

    office = F.col("extension").isin(".docx", ".pptx") & F.col("error").isNull()
    some = files.where(office).withColumn("error", F.when(~intact("content", "extension"), "bad_container"))
    return files.where(~F.coalesce(office, F.lit(False))).unionByName(some)


def run_id(stem: Column, sha256: Column, at: Column) -> Column:
    return F.concat_ws("__", stem, F.left(sha256, F.lit(8)), F.date_format(at, "yyyyMMdd'T'HHmmssSSSSSS"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOCX_SCHEMA = "path string, ord int, kind string, text string, style string, outline int, numbered boolean, bold boolean, monospace boolean, drawings int, rows array<array<string>>"


def _docx(path: str, content: bytes) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
            names = {}
            if "word/styles.xml" in z.namelist():
                for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                    name = s.find(f"{_W}name")
                    names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return

    def run_text(p) -> str:
        parts = []
        for e in p.iter():
            if e.tag == f"{_W}t":
                parts.append(e.text or "")
            elif e.tag == f"{_W}tab":
                parts.append("\t")
            elif e.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        return "".join(parts)

    for i, e in enumerate(body if body is not None else ()):
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            outline = e.find(f"{_W}pPr/{_W}outlineLvl")
            key = style.get(f"{_W}val") if style is not None else None
            runs = [r for r in e.iter(f"{_W}r") if run_text(r).strip()]
            fonts = {(f.get(f"{_W}ascii") or "").lower() for f in e.iter(f"{_W}rFonts")}
            yield (path, i, "paragraph", run_text(e), names.get(key, key), int(outline.get(f"{_W}val")) + 1 if outline is not None else None,
                   e.find(f"{_W}pPr/{_W}numPr") is not None, any(r.find(f"{_W}rPr/{_W}b") is not None for r in runs),
                   bool(fonts & {"consolas", "courier new", "courier"}), sum(1 for x in e.iter() if x.tag.endswith("}drawing")), None)
        elif e.tag == f"{_W}tbl":
            rows = [["\n".join(run_text(p) for p in c.iter(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            yield (path, i, "table", "", None, None, False, False, False, 0, rows)


def docx_items(files: DataFrame) -> DataFrame:
    """Paragraphs and tables of .docx files in order, with what their typing needs; an unreadable file gives no rows."""

    def read(batches):
        columns = [c.split()[0] for c in DOCX_SCHEMA.replace("array<array<string>>", "a").split(", ")]
        for b in batches:
            rows = [r for p, c in zip(b["path"], b["content"]) for r in _docx(p, c)]
            yield pd.DataFrame(rows, columns=columns).astype({"outline": "Int32"})

    return files.where(extension(F.col("path")) == ".docx").select("path", "content").mapInPandas(read, DOCX_SCHEMA)


def docx_blocks(items: DataFrame) -> DataFrame:
    """docx_items typed: code by style, font or beginning, headings by style, outline or bold number, numbered items as lists."""
    style = text.casefold(F.coalesce("style", F.lit("")))
    code = style.rlike("terminal|console|source|preformatted|code") | F.col("monospace") | text.is_code_start(F.col("text"))
    styled = F.regexp_extract(style, r"heading\s*([1-6])", 1)
    level = F.when(styled != "", styled.cast("int")).otherwise(F.col("outline"))
    number = text.canonical_level(F.col("text"))
    record = F.col("text").rlike(text.RECORD_LIKE)
    level = F.when(level.isNull() & number.isNotNull() & (F.length("text") <= 140) & F.col("bold") & ~record & ~F.col("numbered"), number).otherwise(level)
    level = F.when(level.isNotNull() & number.isNotNull(), number).otherwise(level)
    level = F.when(level.isNotNull() & ~(F.col("numbered") & record), F.greatest(F.lit(1), F.least(level, F.lit(6))))
    listed = F.col("numbered") | style.contains("list")
    kind = F.when(F.col("kind") == "table", "table").when(code, "code").when(level.isNotNull(), "heading").when(listed, "list_item").otherwise("paragraph")
    df = items.where("kind = 'table' or trim(text) <> ''")
    return df.withColumns({"block_type": kind, "level": F.when(kind == "heading", level)})


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Rows as JSON lines, non-finite numbers as null, in order within each file."""
    scrub = {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    df = df.withColumns(scrub) if scrub else df
    (df.sortWithinPartitions(*order) if order else df).write.json(path)


def inventory(files: DataFrame) -> DataFrame:
    """(path, size_bytes) of a listing, by path; contents are not read."""
    return files.select("path", F.col("length").alias("size_bytes")).orderBy("path")


def safe_name(s: str) -> str:
    """Driver-side twin of sanitize_stem for folder names."""
    return re.sub("--+", "-", re.sub(r"[^.\w-]+", "-", s, flags=re.A)).strip("-_.")[:80] or "document"
