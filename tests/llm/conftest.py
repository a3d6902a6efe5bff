import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, text_key string, term string, start int, n int, score double, bits int, label string, key string, window int"
LONG = "word thing " * 30_000 + "x" * 3_000


def make(spark, rows):
    """Documents with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", "t", 1, 1, 0.5, 1, "l", "k", 1) for i, t in rows], COLUMNS)


@pytest.fixture(scope="session")
def edges(spark):
    return make(spark, [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, " \n\t"), (None, "no id here"), (5, LONG), (6, "A B C"), (7, "a b c d"), (8, "12 34!"), (9, "émigré Ünïcode 中文 😀")]).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, []).select(*COLUMNS.replace(",", "").split()[::2])


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
