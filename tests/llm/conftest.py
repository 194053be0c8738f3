import duckdb
import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, size string, drop int, score double, fp string"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table of ``(doc_id, text, source)`` rows with further columns whose names clash with results."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "big", 7, 0.25, "x") for i, t, s in rows], DOCUMENT)

    return build


@pytest.fixture
def duck():
    """Runs SQL over Arrow tables given by name."""

    def run(sql, **tables):
        con = duckdb.connect()
        for name, frame in tables.items():
            con.register(name, frame)
        return whole(con.execute(sql).fetchdf())

    return run


def whole(frame):
    """Ids as doubles: pandas has no other plain type for whole numbers with nulls."""
    return frame.astype({"doc_id": "float64"})


def odd_rows():
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one two three", None), (4, "one two three", None), (None, "one two three", "a"),
        (None, None, None), (5, long, "b"), (6, "one two three\nfour", "a"), (7, "One two three\n\nfour five", "a"), (8, "x" * 50_000, "b"),
    ]


@pytest.fixture(scope="session")
def odd():
    return odd_rows()
