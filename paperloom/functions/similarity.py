"""Similarity that built-in expressions lack."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def may_reach(a: Column, b: Column, limit: float) -> Column:
    """Whether two texts are near enough in length to be ``limit`` alike: the ratio is at most twice the shorter over the sum."""
    return 2 * F.least(F.length(a), F.length(b)) >= limit * (F.length(a) + F.length(b))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts (0 where one is null). Put a length filter before it: it runs in Python."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b)])
