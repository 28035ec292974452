import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot double"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text, lang, source) as a documents table with clashing extra columns."""

    def make(rows):
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 0.5) for r in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls everywhere, empty and very long texts, repeated rows."""
    long = " ".join(f"w{i % 977} v{i % 13}" for i in range(60_000))
    return make_docs(
        [
            (0, None, None, None),
            (1, "", "en", "a"),
            (2, " \n\t ", "en", None),
            (3, long, None, "a"),
            (4, "one two", "fr", "b"),
            (5, "one two", "fr", "b"),
            (5, "one two", "fr", "b"),
            (None, "the quick brown fox jumps over the lazy dog " * 20, "en", "a"),
            (7, "the quick brown fox jumps over the lazy dog " * 20, "en", "a"),
            (8, "日本語 \x00   🎉 ﬁ ▁▁ İ", "ja", "c"),
        ]
    )
