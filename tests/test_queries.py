import builtins
import importlib

import pytest

from paperloom.queries import ORACLES, QUERIES
from tests.conftest import comparable, oracle_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    assert comparable(QUERIES[name](spark, sf).toPandas()) == comparable(oracle_rows(ORACLES[name], sf))


def test_titles_that_an_earlier_rule_would_take_follow_the_sql(spark, tmp_path):
    """Titles of every shape that begin with "of" or a number, are labels or dates, are missing, twice there or hold other line marks."""
    titles = ["Plain", "Of the things", "Of all these words, five.", "12 angry men", "1.2Title", "1.2 One 3.4 Two", "2024-01-05", "Status:", "", " lead and trail ", "\ttab", "\tOf five - words with tab.", "a\rb", "a\u2028b", "ends in x"]
    rows = [(i * 5 + k, f"<h1>{t}</h1>") for i, t in enumerate(titles) for k in range(5)] + [(4, "<h1>Of a twin</h1>"), (9, "no title"), (1, None), (None, "<h1>Of no page</h1>"), (-4, "<h1>Of a page below zero</h1>")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    want = oracle_rows(ORACLES["heading_clean_lines"].replace("from pages", f"from '{tmp_path}/pages.parquet/*.parquet'"), "/root/testdata/sf0.001")
    assert comparable(QUERIES["heading_clean_lines"](spark, str(tmp_path)).toPandas()) == comparable(want)


def test_similarity_matches_the_standard_library(spark, sf):
    from difflib import SequenceMatcher

    rows = sorted((r.p_partkey, r.p_name) for r in spark.read.parquet(f"{sf}/part.parquet").collect())
    pairs = {k: (a, b) for (k, a), (_, b) in zip(rows, rows[1:])}
    want = {k: round(SequenceMatcher(None, a, b).ratio(), 4) for k, (a, b) in pairs.items() if 2 * min(len(a), len(b)) >= 0.6 * (len(a) + len(b))}
    assert {r.p_partkey: r.ratio for r in QUERIES["similarity_headers"](spark, sf).collect()} == want


def test_neighbours_lose_no_pair_at_the_ends_of_ranges(spark):
    from paperloom.queries.text_queries import _neighbours

    keys = [1, 2, 999, 1000, 1001, 1999, 5000, 5001, 7999]
    part = spark.createDataFrame([(k, f"n{k}") for k in keys], "p_partkey long, p_name string")
    assert sorted((r.p_partkey, r.next_name) for r in _neighbours(part).collect()) == [(a, f"n{b}") for a, b in zip(keys, keys[1:])]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


def test_entry_without_the_training_data_package(monkeypatch):
    import __spark_entry__ as e

    real = importlib.import_module

    def absent(name, *rest):
        if name.startswith("paperloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
        return real(name, *rest)

    monkeypatch.setattr(e.importlib, "import_module", absent)
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLES)


def test_nothing_else_imports_the_training_data_package():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "paperloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text().replace("blocks_llm_readiness", "").replace("clean_markdown_for_llm", ""), p
    assert builtins.__import__
