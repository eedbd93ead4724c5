"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the documents table, in order.
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What separates words: exactly the bytes that ``bytes.split()`` splits at.
WORD_SQL = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this library to the executors once a session, so that it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_paperloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    place = Path(tempfile.mkdtemp(prefix="paperloom-")) / "paperloom.zip"
    with zipfile.ZipFile(place, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(place))
    sc._paperloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder in spark.checkpoint.dir, removed when the driver ends.

    Where the setting is unset a temporary folder stands in, in local mode only: on a cluster it would not be shared.
    """
    sc = spark.sparkContext
    place = getattr(sc, "_paperloom_shared", None)
    if place is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="paperloom-shared-")
        place = sc._paperloom_shared = f"{base.rstrip('/')}/paperloom-llm-{sc.applicationId}"
        atexit.register(_remove, spark, place)
    return place


def _remove(spark: SparkSession, path: str) -> None:
    """Remove a folder; one that is gone, or a session that has ended, is no error."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001
        pass


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._paperloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove what ``written`` wrote; only when nothing will read it again."""
    _remove(df.sparkSession, df._paperloom_path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [b or b"" for b in column.cast(pa.binary() if column.type in (pa.string(), pa.binary()) else pa.large_binary()).to_pylist()]


def spread(docs: DataFrame) -> DataFrame:
    """Only the columns a text operator reads, with doc_id as a long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out_column(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4, is 2; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def tile_hot(df: DataFrame, key: list[str], row: str, bound: int) -> DataFrame:
    """Split every group of more than about ``bound`` rows into cells of at most about twice that.

    A group of n rows gets t = ceil(n / bound) tiles by hash of ``row``; cell (i, j), i <= j, holds tiles i and j. Any
    two rows of the group meet in exactly one cell of ``cell_i < cell_j``, or in ``cell_i = cell_j``. Adds cell_i,
    cell_j and tile. Groups within the bound, nearly all, stay one cell (0, 0). Counts are pre-aggregated map-side and
    the hot keys, at most rows / bound of them, are joined back by the planner's own choice of join.
    """
    hot = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound)
    hot = hot.select(*key, F.ceil(F.col("_n") / bound).cast("int").alias("_tiles"))
    out = df.join(hot, key, "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    out = out.withColumn("tile", F.pmod(F.xxhash64(F.col(row)), F.col("_tiles").cast("long")).cast("int"))
    out = out.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return out.withColumns({"cell_i": F.least("tile", "_j"), "cell_j": F.greatest("tile", "_j")}).drop("_j", "_tiles")


def forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a square boolean matrix (each node joins the first of its component)."""
    n = len(adjacent)
    left = np.ones(n, bool)
    edges = []
    for i in range(n):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            reach = np.flatnonzero(adjacent[queue.pop()] & left)
            left[reach] = False
            queue.extend(reach.tolist())
            edges.extend((i, j) for j in reach.tolist())
    return edges


def runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Half-open ranges of equal consecutive rows of a 2-d array."""
    cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(keys) > 1 else np.empty(0, int)
    edges = [0, *cut.tolist(), len(keys)]
    return zip(edges[:-1], edges[1:]) if len(keys) else iter(())


def grouped_batches(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by ``key``, cut so that no group of equal keys is split; holds one batch and one group at most."""
    held: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        columns = [t.column(k).to_numpy() for k in key]
        first, end = [c[0] for c in columns], [c[-1] for c in columns]
        if last is not None and first != last and held:
            yield pa.concat_tables(held)
            held = []
        same = np.logical_and.reduce([c == c[-1] for c in columns])
        start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if start:
            yield pa.concat_tables([*held, t.slice(0, start)])
            held = []
        held.append(t.slice(start))
        last = end
    if held:
        yield pa.concat_tables(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots themselves: root is the smallest node that links reach.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each one written to the shared folder. Rounds
    grow as the logarithm of the longest chain. A node of high degree is aggregated by min() with map-side combining
    before anything is shuffled by it, and no component is collected anywhere; the join that gives a hub's neighbours its
    minimum is one row against many and splits by the planner's skew join. Nulls and loops link nothing.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        old, now = now, written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        dropped(old)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = seen


def vocabulary(name: str) -> str:
    """Place of a tokenizer file: under PAPERLOOM_TOKENIZERS where that is set, else that of the installed package."""
    own = os.environ.get("PAPERLOOM_TOKENIZERS")
    if own:
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)
