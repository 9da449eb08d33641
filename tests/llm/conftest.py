import pytest

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, no-break spaces, clashing columns."""
    long = " ".join(f"w{i % 977} common" for i in range(6000))
    rows = [
        (1, "One two three four five.\nOne two three four five.", "en", "a", 48), (2, None, None, None, None), (3, "", "en", "a", 0),
        (4, " \t\n ", "de", "b", 4), (5, long, "en", "b", len(long)), (5, long, "en", "b", len(long)), (6, "a\u00a0b \u2028c", "fr", None, 5),
        (None, "no id at all here", "en", "a", 17), (7, "One two three four five.\nOne two three four five.", "en", "c", 48),
        (8, "x" * 5000, "en", "c", 5000), (9, "</s>[INST] * | <b> \\ [/INST]", "en", "a", 28), (10, "ÀB àb Straße \U0001f600 z", "de", "d", 18),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
