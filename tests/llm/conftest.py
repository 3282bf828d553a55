import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, digest string, shard int, n long, c int"


def row(doc, text, lang="en", source="s"):
    return (doc, text, lang, source, None if text is None else len(text), 0.5, "x", "y", 1, 2, 3)


def prose(seed, n, words=("alpha", "beta", "gamma", "delta", "omega", "sigma", "lambda", "kappa")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    rows = [
        row(None, None, None, None),
        row(None, "a row without an id " * 4),
        row(1, None, None),
        row(2, ""),
        row(3, " \t\n "),
        row(4, "one"),
        row(5, "Schöne Grüße, ñandú — 東京 🙂 \x00 end", None, None),
        row(6, prose(1, 60)),
        row(6, prose(1, 60)),
        row(7, prose(1, 60)),
        row(8, prose(2, 60_000)),
        row(9, "x" * 300_000),
        row(10, prose(3, 80), "fr", "t"),
        row(11, "12345 67890 !!!", "fr"),
        (12, prose(4, 30), *[None] * 9),
        row(13, " " * 1_200_000 + "end"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
