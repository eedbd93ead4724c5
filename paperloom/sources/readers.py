"""Readers that turn documents into items: the native document graph in JSON, HTML and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

_BOX = "struct<l:double,t:double,r:double,b:double>"
_PROV = f"array<struct<page_no:int,bbox:{_BOX}>>"
_REF = "struct<`$ref`:string>"
_CELL = "struct<text:string,start_row_offset_idx:int,end_row_offset_idx:int,start_col_offset_idx:int,end_col_offset_idx:int,column_header:boolean,row_header:boolean,bbox:" + _BOX + ">"
GRAPH_SCHEMA = (
    f"body struct<children:array<{_REF}>>,"
    f"texts array<struct<self_ref:string,parent:{_REF},children:array<{_REF}>,content_layer:string,label:string,level:int,text:string,prov:{_PROV}>>,"
    f"tables array<struct<self_ref:string,parent:{_REF},prov:{_PROV},data:struct<num_rows:int,num_cols:int,table_cells:array<{_CELL}>>>>,"
    f"pictures array<struct<self_ref:string,parent:{_REF},children:array<{_REF}>,image:struct<uri:string,size:struct<width:double,height:double>>,prov:{_PROV}>>,"
    f"groups array<struct<self_ref:string,children:array<{_REF}>>>,"
    "pages map<string,struct<size:struct<width:double,height:double>>>"
)


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: doc_id (its path) and the document graph; a file that is not such a graph has nulls."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), "value")
    return files.select("doc_id", F.from_json("value", GRAPH_SCHEMA, {"mode": "PERMISSIVE"}).alias("g")).select("doc_id", "g.*")


def graph_edges(graphs: DataFrame) -> DataFrame:
    """(doc_id, parent, ref, pos) of the reading tree; the body's children have no parent."""
    root = graphs.select("doc_id", F.lit(None).cast("string").alias("parent"), F.posexplode("body.children").alias("pos", "c"))
    out = root
    for kind in ("groups", "texts", "pictures"):
        item = graphs.select("doc_id", F.explode(kind).alias("i"))
        out = out.unionByName(item.select("doc_id", F.col("i.self_ref").alias("parent"), F.posexplode("i.children").alias("pos", "c")))
    return out.select("doc_id", "parent", F.col("c")["$ref"].alias("ref"), "pos").where("ref is not null")


def graph_items(graphs: DataFrame) -> DataFrame:
    """Texts, tables and pictures of graphs, one row each: doc_id, ref, kind, label, level, text, page_no, box, num_rows, num_cols, uri, width, height."""
    at = lambda c: F.get(F.col(c), F.lit(0))
    t = graphs.select("doc_id", F.explode("texts").alias("i")).select("doc_id", F.col("i.self_ref").alias("ref"), F.lit("text").alias("kind"), "i.label", "i.level", "i.text", at("i.prov").alias("p"), F.lit("{}").alias("_x"))
    b = graphs.select("doc_id", F.explode("tables").alias("i")).select("doc_id", F.col("i.self_ref").alias("ref"), F.lit("table").alias("kind"), F.lit("table").alias("label"), F.lit(None).cast("int").alias("level"), F.lit("").alias("text"), at("i.prov").alias("p"), F.to_json(F.struct("i.data.num_rows", "i.data.num_cols")).alias("_x"))
    p = graphs.select("doc_id", F.explode("pictures").alias("i")).select("doc_id", F.col("i.self_ref").alias("ref"), F.lit("picture").alias("kind"), F.lit("picture").alias("label"), F.lit(None).cast("int").alias("level"), F.lit("").alias("text"), at("i.prov").alias("p"), F.to_json(F.struct(F.col("i.image.uri").alias("uri"), F.col("i.image.size.width").alias("width"), F.col("i.image.size.height").alias("height"))).alias("_x"))
    x = F.from_json("_x", "num_rows int, num_cols int, uri string, width double, height double").alias("x")
    out = t.unionByName(b).unionByName(p).select("doc_id", "ref", "kind", "label", "level", "text", F.col("p.page_no").alias("page_no"), F.col("p.bbox").alias("box"), x)
    return out.select("doc_id", "ref", "kind", "label", "level", "text", "page_no", "box", "x.*")


def graph_cells(graphs: DataFrame) -> DataFrame:
    """Table cells in tall form, with their order in the file."""
    t = graphs.select("doc_id", F.posexplode("tables").alias("table_idx", "i")).select("doc_id", "table_idx", F.col("i.self_ref").alias("ref"), F.posexplode("i.data.table_cells").alias("cell_ord", "c"))
    return t.select(
        "doc_id", "table_idx", "ref", "cell_ord", "c.text", F.col("c.start_row_offset_idx").alias("start_row"), F.col("c.end_row_offset_idx").alias("end_row"), F.col("c.start_col_offset_idx").alias("start_col"),
        F.col("c.end_col_offset_idx").alias("end_col"), F.coalesce("c.column_header", F.lit(False)).alias("column_header"), F.coalesce("c.row_header", F.lit(False)).alias("row_header"), F.col("c.bbox.l").alias("left"), F.col("c.bbox.r").alias("right"),
    )


def graph_tables(graphs: DataFrame) -> DataFrame:
    """Tables with place on the page and page size, as integrity.snapshots takes them."""
    t = graphs.select("doc_id", "pages", F.posexplode("tables").alias("table_idx", "i"))
    first = F.get(F.col("i.prov"), F.lit(0))
    t = t.select("doc_id", "pages", "table_idx", F.col("i.self_ref").alias("ref"), first["page_no"].alias("page"), first["bbox"]["t"].alias("top"), first["bbox"]["b"].alias("bottom"), F.col("i.data.num_rows").alias("num_rows"), F.col("i.data.num_cols").alias("num_cols"))
    size = F.try_element_at("pages", F.col("page").cast("string"))["size"]
    return t.withColumns({"page_height": size["height"], "page_width": size["width"]}).drop("pages")


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, ord, block_type, level, text) of simple HTML: headings, paragraphs and list items in page order."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<((?:h1|h2|p|li)>.*?)</"), F.lit(1))
    df = pages.select("page_id", F.posexplode(found).alias("ord", "x"))
    tag = F.regexp_extract("x", "^([a-z0-9]+)>", 1)
    body = F.regexp_replace(text.normalize_entities(F.regexp_replace("x", "^[a-z0-9]+>", "")), "<[^>]*>", " ")
    kind = F.when(tag.startswith("h"), "heading").when(tag == "li", "list_item").otherwise("paragraph")
    level = F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int"))
    return df.select("page_id", "ord", kind.alias("block_type"), level.alias("level"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text"))


def markdown_items(docs: DataFrame) -> DataFrame:
    """Markdown texts (doc_id, text) as items (doc_id, ord, label, level, text): headings, list items, code lines, paragraphs."""
    from ..operators import lines as L

    df = L.with_fences(L.to_lines(docs)).where("not is_fence")
    h = r"^(\#{1,6})\s+(.*)$"
    label = F.when(F.col("in_fence"), "code").when(F.col("line").rlike(h), "section_header").when(F.col("line").rlike(r"^\s*(?:[-*+]|\d+[.)])\s+"), "list_item").otherwise("text")
    body = F.when(label == "section_header", F.regexp_extract("line", h, 2)).when(label == "list_item", F.regexp_replace("line", r"^\s*(?:[-*+]|\d+[.)])\s+", "")).otherwise(F.col("line"))
    return df.select("doc_id", F.col("line_no").alias("ord"), label.alias("label"), F.when(label == "section_header", F.length(F.regexp_extract("line", h, 1))).alias("level"), body.alias("text")).where("trim(text) <> ''")
