"""Scalar text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that are never headings when they carry a bullet or a colon.
FIELD_LABELS = "claim date depth range status width".split()
#: How source code begins: a comment or fence, a key of a manifest, an opened block, a command.
CODE_START = rf"(?i)^\s*(?:{'|'.join(['```', '/[/*]', '#'])}|(?:{'|'.join('services kind apiVersion'.split())})\s*:|(?:{'|'.join('node pipeline stages?'.split())})\s*\{{|(?:{'|'.join('docker kubectl from'.split())})\s+)"
YAML_KEY = r"^\s*([?-]\s+)?[_a-zA-Z][\w.\-]*\s*:"
#: Words of requirements and of table definitions, and snake-case names at the start.
RECORD_LIKE = rf"(?i)(?:\b(?:{'|'.join('check index required shall should must unique'.split())}|not\s+null|foreign\s+key)\b|^[a-z]\w*_[a-z]\w*)"
NUMBERED = r"^\s*(\d+(?:[.]\d+){0,5})[.]?\s+(.+)$"
RESIDUE = "saag ieee gere geel gee eee cea caan aee aoe aay".split()
MAX_LEVEL = 6


def strip(c: Column) -> Column:
    """Without white space at either end (``trim`` knows spaces only): the characters that ``\\s`` matches, without a pattern."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def text_signature(c: Column) -> Column:
    """ASCII letters and digits of the case-folded text."""
    return F.regexp_replace(casefold(c), "[^a-z0-9]+", "")


def loose_signature(c: Column) -> Column:
    """Word characters of any script of the case-folded text."""
    return F.regexp_replace(casefold(c), r"(?U)\W+", "")


def grid_signature(rows: Column) -> Column:
    return loose_signature(F.array_join(F.transform(rows, lambda r: F.array_join(r, "\t")), "\n"))


def normalize_entities(c: Column) -> Column:
    """&amp; first, so that a doubly escaped entity is decoded twice."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def word_count(c: Column) -> Column:
    """Whitespace-separated words: the default token counter."""
    return F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))


def looks_like_date(c: Column) -> Column:
    return c.rlike(r"^\d\d?[/-][a-zA-Z]{3,9}[/-]\d{2,4}$") | c.rlike(r"^\d{4}[/-]\d\d?[/-]\d\d?$")


def is_false_sentence_heading(c: Column) -> Column:
    s = strip(c)
    return looks_like_date(s) | (s.endswith(".") & (word_count(s) >= 5))


def bare_label(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), "^[·•\\- ]+", ""))


def is_false_label_heading(c: Column) -> Column:
    s, label = strip(c), bare_label(c)
    return ((label != s) | label.endswith(":")) & F.lower(strip(F.regexp_replace(label, ":+$", ""))).isin(FIELD_LABELS)


def normalize_sentence(c: Column) -> Column:
    s = F.regexp_replace(strip(c), r"\s+([.,;:])", "$1")
    return F.when(looks_like_date(s), s).otherwise(F.regexp_replace(s, r"\s*-\s*", " - "))


def numbered_heading(c: Column) -> Column:
    """Markdown heading of a numbered title, its level one more than its number's parts; null for anything else."""
    at = r"(?d)^(\d+(?:[.]\d+)*)([.]?)\s+(.+)$"  # (?d): only a line feed ends a line
    number = F.regexp_extract(c, at, 1)
    level = F.least(F.size(F.split(number, r"\.")) + 1, F.lit(MAX_LEVEL))
    text = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), number, F.regexp_extract(c, at, 2), F.lit(" "), strip(F.regexp_extract(c, at, 3)))
    return F.when(c.rlike(at) & ~looks_like_date(c), text)


def canonical_level(c: Column) -> Column:
    """Level of a numbered title in canonical blocks: the parts of its number, 6 at most; null without a number."""
    number = F.regexp_extract(c, NUMBERED, 1)
    return F.when(number != "", F.least(F.size(F.split(number, r"\.")), F.lit(MAX_LEVEL)))


def join_header_fragment(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"^([A-Z][a-zA-Z]{3}[a-zA-Z]*)\s+([a-z])$", "$1$2")


def is_numeric_label(c: Column) -> Column:
    return strip(c).rlike(r"^\d+$")


def escape_cell(c: Column, line_breaks: bool = False) -> Column:
    c = F.replace(c, F.lit("|"), F.lit("\\|"))
    return F.replace(c, F.lit("\n"), F.lit("<br>")) if line_breaks else c


def strip_emphasis(c: Column) -> Column:
    """Without bold markers and with escaped markers restored."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<!\\)(\*\*|__)", ""), r"\\([*_])", "$1")


def code_language(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(low.contains("apiversion:") | low.contains("kind:") | low.contains("services:") | c.rlike(YAML_KEY), "yaml")
        .when(low.contains("pipeline") | low.contains("stage("), "groovy")
        .when(low.startswith("docker ") | low.startswith("kubectl ") | low.startswith("#!/"), "bash")
        .otherwise("text")
    )


def is_code_start(c: Column) -> Column:
    return c.rlike(CODE_START)


def continues_code(c: Column) -> Column:
    return c.rlike(YAML_KEY) | c.rlike(r"^\s*[\[\]{}-]") | c.rlike(r"^\s+[A-Za-z_]")


def picture_name(ref: Column) -> Column:
    """File of the picture a reference ends in; files count from one."""
    n = F.regexp_extract(ref, r"/(\d+)$", 1)
    return F.when(n != "", F.format_string("picture-%04d.png", n.cast("int") + 1))


def needs_value(c: Column) -> Column:
    return c.rlike(r"(?:=|:)\s*$")


def parse_row(line: Column) -> Column:
    """Cells of a Markdown table row."""
    inner = F.regexp_replace(F.regexp_replace(strip(line), r"^\|+", ""), r"\|+$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda x: strip(F.replace(x, F.lit("\\|"), F.lit("|"))))


def is_separator(cells: Column) -> Column:
    return (F.size(cells) > 0) & F.forall(cells, lambda x: x.rlike("^:?-{3,}:?$"))


def starts_block(line: Column) -> Column:
    return line.rlike(r"^(?:!\[|#{1,6}\s|\|)")


def rows_continue(left: Column, right: Column) -> Column:
    """A row is cut by a page break: the next row lacks its first cell, or this one's first cell ends in a joiner."""
    first = F.get(left, F.lit(0))
    return (strip(F.get(right, F.lit(0))) == "") | strip(first).rlike(r"[_\-/\\]$")


def merge_cells(left: Column, right: Column, markdown: bool = True) -> Column:
    """Cell of a row cut by a page break; ``markdown``: short upper-case tails are joined without a space as well."""
    a, b = strip(left), strip(right)
    out = F.when(a == "", b).when(b == "", a).when(a.rlike(r"[_\-/\\]$"), F.concat(a, b))
    if markdown:
        upper = lambda x: (x == F.upper(x)) & (x != F.lower(x)) & ~x.contains(" ")
        out = out.when(upper(a) & upper(b) & (F.length(b) <= 3), F.concat(a, b))
    return out.otherwise(F.concat(a, F.lit(" "), b))


def sanitize_stem(name: Column) -> Column:
    """File name without folders and extension, in safe characters, 80 at most."""
    base = F.regexp_extract(F.regexp_replace(name, "/+$", ""), "([^/]*)$", 1)
    stem = F.when(base.rlike(r"^\.*$"), F.lit("")).otherwise(strip(F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")))
    safe = F.regexp_replace(F.regexp_replace(stem, r"[^.\w-]+", "-"), "-{2,}", "-")
    safe = F.regexp_replace(safe, r"^[._-]+|[._-]+$", "")
    return F.substring(F.coalesce(F.nullif(safe, F.lit("")), F.lit("document")), 1, 80)


def mime_by_signature(content: Column) -> Column:
    """Type by the first bytes; valid text without NUL is text/plain."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.is_valid_utf8(content.cast("string")) & ~F.contains(content.cast("string"), F.lit("\x00"))
    return (
        F.when(head.startswith("255044462D"), "application/pdf")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "image/tiff")
        .when(head.startswith("424D"), "image/bmp")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.startswith("504B"), "application/zip")
        .when(text, "text/plain")
        .otherwise("application/octet-stream")
    )


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_useful_ocr_line(line: Column) -> Column:
    compact = F.regexp_replace(line, r"\s+", "")

    def test(s: Column) -> Column:
        c, n, words = s["c"], s["n"], s["w"]
        residue = (F.size(words) > 0) & F.forall(words, lambda w: w.isin(RESIDUE))
        return (F.length(c) >= 2) & (n > 0) & ~residue & ~F.lower(c).isin("an", "oo") & ((F.size(words) > 0) | c.rlike("^[A-Z0-9]{2,5}$"))

    tokens = lambda t: F.struct(compact.alias("c"), F.size(t).alias("n"), F.transform(F.filter(t, lambda x: F.length(x) >= 3), F.lower).alias("w"))
    # most lines that are useless have no letter or digit, and need no tokens
    return F.when(line.rlike("[A-Za-z0-9]"), with_value(with_value(_tokens(line), tokens), test)).otherwise(F.when(line.isNotNull(), F.lit(False)))


def clean_ocr(text: Column) -> Column:
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: strip(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, is_useful_ocr_line), "\n")


def has_useful_ocr(text: Column) -> Column:
    long_enough = F.length(F.regexp_replace(text, r"\s+", "")) >= 12

    def test(t: Column) -> Column:
        return with_value(
            F.transform(F.filter(t, lambda x: F.length(x) >= 3), F.lower),
            lambda long: (F.size(long) >= 2) & (F.size(F.array_distinct(long)) >= 2) & F.exists(t, lambda x: F.length(x) >= 5) & (F.size(t) - F.size(long) <= F.size(long) * 1.5),
        )

    return long_enough & with_value(_tokens(text), test)
