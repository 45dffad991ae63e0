import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text, lang, source) rows; n_chars follows."""

    def of(rows, schema=DOCS):
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], schema)

    return of


@pytest.fixture
def awkward(make):
    """Nulls in every column, empty and long texts, ties and repeated rows, clashing extra columns."""
    from pyspark.sql import functions as F

    rows = [
        (1, "alpha beta gamma delta\nsame line here", "en", "a"),
        (1, "alpha beta gamma delta\nsame line here", "en", "a"),
        (None, "alpha beta gamma delta", None, None),
        (None, None, None, None),
        (2, None, "en", "a"),
        (3, "", "de", "b"),
        (4, " \n\t ", None, "b"),
        (5, "wort " * 20000, "de", None),
        (6, "x" * 30000, "fr", "a"),
        (2**40, "Ünï cödé \U0001f600 \x00 text\x85", "es", "c"),
    ]
    extra = ["shard", "slot", "fp", "component_id", "a", "b", "node", "root", "n_tokens", "line", "site", "flagged", "n", "lines", "salt", "value", "k1", "score", "kept", "weight", "block"]
    return make(rows).withColumns({c: F.lit("own") for c in extra})
