import pytest

SF = "/root/testdata/sf0.01"

# null, empty, white space, ties, repeated rows and ids, a null id, a long text, and columns with clashing names
LONG = "word " * 30_000 + "end"
ROWS = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "One two three four five six seven", "en"),
    (5, "one two three four five six seven", "en"), (5, "one two three four five six seven", "en"),
    (6, "ONE TWO three four five six seven", None), (7, LONG, "fr"), (None, "one two", "fr"), (None, None, None),
    (8, "Été à l'école, où ça? 日本 😀", "fr"), (9, "mail a.b@c-d.org or 10.0.0.1 and 300.1.1.1", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, lang, "src0", None if t is None else len(t), 1, 2.5, "x", 3) for i, t, lang in ROWS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, length int, rank double, "
              "digest string, cid int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
