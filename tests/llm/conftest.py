import random

import pytest

#: Column names that operators use inside; they must not disturb them.
CLASHING = ("k", "t", "fp", "rid", "found", "claims", "score", "tokens", "ids", "part", "carry", "n", "n_chars")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, one id with two texts, and clashing extra columns."""
    rng = random.Random(11)
    words = ["the", "of", "and", "garden", "river", "Stone", "über", "été", "light,", "x1"]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(30_000))
    passage = " ".join(f"w{i}" for i in range(70))
    texts = [(0, "the green house of the hill"), (1, None), (2, ""), (3, " \n\t "), (4, long), (4, "another text of the same id"), (5, passage + " tail one"), (6, "head " + passage), (6, "head " + passage), (None, passage), (7, "a\x1cb <|endoftext|> 😀 é"), (8, "x " * 200), (9, "x " * 130 + "y")]
    rows = [(d, t, None if d == 3 else "en", "src", *([d] * len(CLASHING))) for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} long" for c in CLASHING))


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.filter("false")
