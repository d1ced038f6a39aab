"""Documents with every odd case at once, and none at all."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, rep int, bands int, words int, rank int, shard int, class string, label string"


def odd_rows():
    rng = random.Random(3)
    long_text = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(i % 977) for i in range(30_000))
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two three"), (5, "one two three"), (5, "one two three"), (None, "a text without an id but with more than five words"),
        (7, long_text), (8, long_text + " tail"), (9, "ÀÉ ñ 日本語 🙂 mixed, text; with \x00 and   odd marks"), (10, "word " * 300), (11, "<|endoftext|> is ordinary here"),
    ]
    return [(i, t, "en" if i and i % 2 else None, None, None, "x", 1, 2, 3, 4, 5, "c", "l") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
