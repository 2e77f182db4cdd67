import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
#: Nulls, empty and odd texts, ties, repeated rows, a very long text, and columns with clashing names.
ODD = [
    (1, None, None, None),
    (None, "Null id here", "en", None),
    (2, "", "en", "a"),
    (3, " \t\n", "en", "a"),
    (4, "one", "en", "a"),
    (5, "one two three four five six seven eight nine ten eleven", "en", "a"),
    (5, "one two three four five six seven eight nine ten eleven", "en", "a"),
    (6, "ONE two\x0bthree four five six seven eight nine TEN eleven", "fr", "b"),
    (7, "Ünïcode   wörds and <|endoftext|> x<|startoftext|>y 12345 !?", "de", "b"),
    (8, "w" * 5000 + " " + "long words " * 20000, "en", "a"),
    (9, "\x1c\x1d ### $$ 99", None, "c"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in ODD], "doc_id long, text string, lang string, source string, n long, rid long, word string, n_words int")


@pytest.fixture
def no_docs(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()
