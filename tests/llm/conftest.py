import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, kept int, n_removed string, body double, spans int, n_words string"
"""The columns of documents and some whose names the operators use themselves."""


def sentence(rng, n):
    return " ".join("".join(rng.choice("abdeilnorst") for _ in range(rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    rng = random.Random(4)
    base = sentence(rng, 120)
    lines = "\n".join(sentence(rng, 9) for _ in range(12))
    long = sentence(rng, 30_000)
    texts = [
        (1, base), (2, base), (3, base.replace("a", "e", 2)), (4, None), (5, ""), (6, " \n\t "), (7, lines), (8, lines + "\nend of it"), (9, long), (10, sentence(rng, 60) + " " + base),
        (11, "One TWO <|endoftext|> don't  two   spaces é中\U0001f600 \x1c x"), (7, lines), (None, base), (None, sentence(rng, 40)), (12, "x" * 5000), (13, "same same " * 300), (14, "a\n\n\n\nb\n\n\n\nc"),
    ]
    langs = ["en", None, "de", ""]
    rows = [(i, t, langs[k % 4], "s", len(t or ""), k, "r", 0.5, k, "w") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
