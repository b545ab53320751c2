"""Fixtures of these tests: odd rows, and the test documents."""

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, `__id` string, score string"


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows, and columns with names that clash."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a"), (2, "The quick  brown fox jumps over the lazy dog", "en", "a"), (3, "le chat noir et le chien blanc", "fr", None),
        (3, "le chat noir et le chien blanc", "fr", None), (4, None, None, "b"), (5, "", "en", "b"), (6, " \t\n", None, "b"), (None, "no id here at all", "en", "c"), (None, "no id here at all", "en", "c"),
        (7, long, "en", "c"), (8, "12345 67890 !!", "en", "c"), (9, "x", "fr", "a"), (3, "another text under the same id", "en", "a"), (10, "héé ﬁ 😀 ▁x \x00 z", "fr", "a"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 5, "own", "own") for i, t, lang, s in rows], SCHEMA).cache()


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
