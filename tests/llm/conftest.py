import pytest

LONG = " ".join(f"word{i % 97}" for i in range(30_000))
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 2

#: Nulls in any column, empty and very long texts, ties, repeated rows, odd white space, special strings, other scripts.
EDGE = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
    (2, "ONE two three four five six seven eight nine ten eleven  twelve", "en", None),
    (3, None, "en", "b"), (4, "", None, "b"), (5, "  \n\t ", "fr", "b"), (6, LONG, "en", "a"), (7, LONG + " tail", "en", "a"),
    (None, "a null key with some words to hold it up and a few more", "de", "c"), (8, "short", "es", "c"),
    (9, BASE, "en", "a"), (10, BASE.replace("psi", "PSI"), "en", "b"), (11, BASE + " and one more", "en", "a"),
    (12, "double  space\n\n\nlines \n with ends\r\n and <|endoftext|> inside <|startoftext|> nbsp sep \x1cfs é ́x", "fr", "d"),
    (13, "Straße Ünïcödé ἈΣ İstanbul 東京 🙂🙂 don't we'll they've 12345 !!!??? ###", "de", "d"),
    (14, "line one is here\nline two\nline one is here\n\nline one is here\n \n", "en", "d"),
    (15, "x" * 50_000, "en", "d"), (16, "<|endoftext|>\n<|endoftext|> a<|endoftext|>b", "en", "d"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame([(*r, 7, "x", 1.5) for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long, shard string, score double")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (None, 1, 1), (6, None, None), (9, 1, 0), (9, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
