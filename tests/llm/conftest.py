import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """make(texts or rows) -> documents; a text's id is its place."""

    def run(rows, extra: bool = False):
        rows = [r if isinstance(r, tuple) else (i, r, "en", "web", len(r or "")) for i, r in enumerate(rows)]
        docs = spark.createDataFrame(rows, DOCUMENTS)
        if extra:  # names that the operators use themselves
            for name in ("simhash", "component", "score", "row", "toxic", "curve", "share", "sha", "news", "name", "slot", "mix_slot", "pieces", "key", "label", "tokens", "total", "block", "first", "id"):
                docs = docs.selectExpr("*", f"'x' AS {name}")
        return docs

    return run


@pytest.fixture(scope="session")
def odd():
    """Rows with nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (0, "the cat sat on the mat and the dog sat on the log", "en", "web", 49),
        (1, None, "en", "web", None),
        (2, "", None, None, 0),
        (3, " \t\n ", "en", "news", 4),
        (4, long, "en", "web", len(long)),
        (None, "the cat sat on the mat and the dog sat on the log", "de", "web", 49),
        (0, "the cat sat on the mat and the dog sat on the log", "en", "web", 49),
        (5, "Ünï \U0001f600 ▁ mark", None, "news", None),
        (6, "one", "en", None, 3),
    ]
