"""Awkward documents, and the documents of the smallest tables."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
LINE = "A line that is quite long and that three documents have"


def rows():
    shared = f"{LINE}\nown words of this one"
    base = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, "one", "en", None), (None, "text without an id, of some ten words or so", "en", "b"),
        (5, shared + " five", "en", "a"), (6, shared.upper() + " six", "fr", "a"), (7, "  " + shared + " seven", "en", "b"), (7, "  " + shared + " seven", "en", "b"),
        (8, "é" * 50 + " naïve\nÉCOLE " + "ß" * 30, "fr", "b"), (9, LONG, "en", "c"), (10, LONG.replace("w5x5 ", ""), "en", "c"), (11, "the same text twice " * 12, "en", "c"),
        (12, "the same text twice " * 12, "en", "c"), (13, "a\r\nb\x0bc\x0cd", "en", "c"), (14, "<|endoftext|> mid <|endoftext|>", "en", "c"),
        (15, "#*$%&|<> " * 30, "en", "a"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in base]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def clashing(awkward):
    """The awkward rows with extra columns named like results and like inner columns."""
    from pyspark.sql import functions as F

    names = ["n_lines", "n_dropped", "kept", "n_words", "size", "taken", "target", "score", "class_id", "h1", "key", "part", "start", "fingerprint", "tokens", "n_tokens", "base_failed"]
    return awkward.withColumns({n: F.lit("extra") for n in names})
