import pytest

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, fp long, spans string, component_id string, rank int"


@pytest.fixture
def docs(spark):
    """Builds documents from (doc_id, text), with further columns whose names operators use inside."""

    def build(rows):
        return spark.createDataFrame([(i, t, None, "s", None, 7, "x", "y", 1) for i, t in rows], EXTRA)

    return build


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} secret token" for i in range(30_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog and runs away"), (2, None), (3, ""), (4, "   \t\n "), (None, "A text without an id, which stays"), (6, long), (7, "x" * 200_000),
        (8, "The quick brown fox jumps over the lazy dog and runs away"), (8, "The quick brown fox jumps over the lazy dog and runs away"), (9, "été über ñandú Ωmega 日本語   two"), (10, "a"), (11, "12345 !!! ???"), (12, "one <|endoftext|> two"), (None, None),
    ]
