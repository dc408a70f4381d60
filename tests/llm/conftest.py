import random

import pytest

EXTRA = "node string, fp string, score string, spans string, a string, b string, text_key string, size string, pieces string, least string"


def word(rng, letters="abcdefghijklmnop"):
    return "".join(rng.choice(letters) for _ in range(rng.randint(3, 9)))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls everywhere, empty, very long and repeated rows, ties, and columns with names that operators use."""
    rng = random.Random(1)
    long = " ".join(word(rng) for _ in range(30_000))
    base = " ".join(word(rng) for _ in range(300))
    rows = [(0, None), (1, ""), (2, "   \n\t"), (3, long), (4, base), (4, base), (5, base), (None, base), (None, None), (6, "x" * 50_000), (7, "one two"), (8, "ü　 漢字   a<|endoftext|>"), (9, "AKIA" + "A" * 16 + " token = abcdef0123456789abcdef " + base)]
    rows = [(*r, None, None, len(r[1] or ""), *["clash"] * 10) for r in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 0, 0), (7, 0, 1), (None, 1, 1), (9, None, None), (5, 7, 7)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    return lambda name, sf="sf0.01": spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def words(rng):
    return lambda n: " ".join(word(rng) for _ in range(n))
