import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string, key string, found int"


def prose(rng, n):
    parts = ("the", "er", "an", "in", "on", "re", "ti", "es", "ly", "ou", "ing", "ea")
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    """Texts with copies, near copies, shared passages, nulls, empties, one very long text, repeated rows."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(5, 120)) for _ in range(60)]
    texts += texts[:5] * 3
    for k in range(8):
        words = texts[20].split()
        words[k % len(words)] = "changed"
        texts.append(" ".join(words))
    shared = prose(rng, 30)
    texts += [prose(rng, 20) + "\n" + shared + "\n" + prose(rng, 20) for _ in range(6)]
    texts += [None, "", " \n\t ", "a", "one two", "one two", "x" * 300, "漢字 éà 12 +1 (377) 555-0271", prose(rng, 6000)]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "a", "b", None)[i % 4], 1, "t", "k", i) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[0], "en", "a", 1, "t", "k", 0), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
