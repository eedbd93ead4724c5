import pytest

EXTRA = "component_id long, fingerprint string, score double, n_tokens long, kept boolean, a long, b long, node long, root long, tile int, file string, hot boolean, held boolean, _turn int, _found string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, long and repeated texts, null ids, and columns whose names clash with results."""
    long = " ".join(f"word{i % 977} the" for i in range(30_000))
    texts = [None, "", " \n\t ", "one", "a b c d", long, long, "tie tie tie tie tie", "é漢字🙂 x\x00y", "a b c d", "x" * 50_000, "mail a.b@c.example.org now"]
    rows = [(i if i != 4 else None, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src0", None) for i, t in enumerate(texts)]
    rows.append((9, "a b c d", "en", "src0", 7))  # a repeated row
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
    return spark.createDataFrame([(*r, *[None] * len(EXTRA.split(","))) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
