import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rules_text int, shard string, n long, row int"
BASE = "The quick brown fox jumps over the lazy dog while seven wizards box quietly near the old stone bridge today."


def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, clashing column names."""
    long_text = " ".join(f"word{k % 977}x{k}" for k in range(60_000))
    texts = [BASE, BASE, BASE + " Again.", None, "", " \t\n ", "one", "Ünïcödé ẞtraße 日本語 \U0001f600 text", long_text, "a" * 5000, "#" * 40]
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), 1, "x", 5, 7) for k, t in enumerate(texts)]
    rows.append((None, BASE, None, None, None, None, None, None, None))
    rows.append((3, None, None, "s1", 0, None, None, None, None))
    rows += [(20, BASE, "en", "s0", 5, 1, "x", 5, 7)] * 2
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def make(spark, texts, **columns):
    """Documents 0, 1, ... with the given texts; further columns by name."""
    rows = [
        (k, t, "en", columns.get("source", ["s"] * len(texts))[k], len(t or ""), None, None, None, None)
        for k, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)
