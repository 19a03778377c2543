import random

import pytest

EXTRA = "score double, predicted int, node string, part int, size int, copies int, key string, matches int, tie int, row int, kept int, text2 string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ti", "es", "ha", "ing", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    base = prose(rng, 120)
    rows = [
        (1, base, "a"), (2, None, "a"), (3, "", "b"), (4, " \n\t ", None), (5, long, "b"), (6, long, "b"),
        (7, base + " extra", None), (7, base + " extra", None), (8, "two words", "c"), (9, "two words", "c"), (None, prose(rng, 60), "a"), (None, None, None),
        (10, "a@b.co 1.2.3.4 4111 1111 1111 1111 +1 (202) 555-0101", "c"), (11, "x" * 5000, "c"), (12, "é ñ 日本 " * 200, "a"),
    ]
    extra = (1.0, 2, "n", 3, 4, 5, "k", 6, 7, 8, 9, "t")
    return spark.createDataFrame([(*r, None, None, *extra) for r in rows], f"doc_id bigint, text string, source string, lang string, n_chars bigint, {EXTRA}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (7, 1, 0), (8, 0, 1), (99, 1, 1), (None, 1, 1), (6, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    """doc_id and text in order, null texts as empty ones."""
    return [(r.doc_id, r.text or "") for r in documents.orderBy("doc_id").collect()]
