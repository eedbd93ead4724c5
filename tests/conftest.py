import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def oracle_rows(sql: str, sf_dir: str):
    """Rows of a DuckDB query over the driver's tables, as a pandas frame."""
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c.execute(sql).df()


def comparable(frame):
    """Rows as sorted tuples, columns by name, numbers and nulls unified."""
    import math

    import numpy as np
    import pandas as pd

    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float | np.floating) and math.isnan(x)):
            return None
        if isinstance(x, bool | np.bool_):
            return bool(x)
        if isinstance(x, int | np.integer | float | np.floating):
            return round(float(x), 6)
        return x

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(one, r)) for r in frame.astype(object).itertuples(index=False)), key=str)
