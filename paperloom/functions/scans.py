"""Ordered scans inside one document as window expressions: running state without a loop.

All of them partition by a document key, so the only shuffle is one exchange on that key, which they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(doc: str | list[str], order: str | list[str]) -> WindowSpec:
    return Window.partitionBy(*([doc] if isinstance(doc, str) else doc)).orderBy(*([order] if isinstance(order, str) else order))


def inside_fence(is_fence: Column, w: WindowSpec) -> Column:
    """Whether a line lies between two fence lines; fence lines themselves do not."""
    return (F.sum(is_fence.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2 == 1) & ~is_fence


def previous(value: Column, where: Column, w: WindowSpec) -> Column:
    """Value of the nearest earlier row for which ``where`` holds."""
    return F.last(F.when(where, value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def island(flag: Column, w: WindowSpec) -> Column:
    """Number of the run of equal flags that a row belongs to."""
    change = F.coalesce((F.lag(flag).over(w) != flag).cast("int"), F.lit(1))
    return F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def odd_in_run(df: DataFrame, flag: str, doc: list[str], order: list[str]) -> DataFrame:
    """Adds ``fires``: of each run of true flags the 1st, 3rd, ... rows, which is what a greedy scan for non-overlapping pairs takes."""
    w = ordered(doc, order)
    df = df.withColumn("_island", island(F.col(flag), w))
    inner = Window.partitionBy(*doc, "_island").orderBy(*order)
    return df.withColumn("fires", F.col(flag) & (F.row_number().over(inner) % 2 == 1)).drop("_island")


def section_paths(df: DataFrame, doc: str, order: str, is_heading: str, level: str, text: str, deepest: int = 6) -> DataFrame:
    """Adds ``depth`` and ``section_path``: headings open at each row.

    A stack that is cut to level - 1 entries by each heading and then takes it has, after the n-th heading of level L,
    the depth n + min(0, least L - n so far); an entry at depth d is the latest heading that had this depth.
    """
    w = ordered(doc, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_n", F.sum(F.col(is_heading).cast("int")).over(w))
    df = df.withColumn("_m", F.min(F.when(F.col(is_heading), F.col(level) - F.col("_n"))).over(w))
    df = df.withColumn("_d", F.when(F.col(is_heading), F.col("_n") + F.least(F.lit(0), F.col("_m"))))
    df = df.withColumn("depth", F.coalesce(F.last("_d", ignorenulls=True).over(w), F.lit(0)).cast("int"))
    at = [F.last(F.when(F.col("_d") == d, F.col(text)), ignorenulls=True).over(w) for d in range(1, deepest + 1)]
    return df.withColumn("section_path", F.slice(F.array(*at), F.lit(1), F.least(F.col("depth"), F.lit(deepest)))).drop("_n", "_m", "_d")
