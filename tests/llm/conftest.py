import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "key string, node int, words string, row string, spans int, block int, length int, rank int"
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, g, s, None if t is None else len(t), "k", 1, "w", "r", 2, 3, 4, 5) for i, t, g, s in rows], SCHEMA
        )

    return make


LONG = " ".join(f"word{i}" for i in range(40_000))
A = "the quick brown fox jumps over the lazy dog and then goes home to sleep under the old oak tree near the river"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties and rows that repeat."""
    return [
        (1, A, "en", "s"),
        (1, A, "en", "s"),
        (2, A, "en", "t"),
        (3, None, "en", "s"),
        (4, "", None, "s"),
        (5, " \n\t ", "en", None),
        (None, A + " today", "en", "s"),
        (6, LONG, "en", "s"),
        (7, "!!! ###", "en", "s"),
        (8, "é", "fr", "s"),
        (None, None, None, None),
    ]


@pytest.fixture(scope="session")
def tables():
    connection = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection
