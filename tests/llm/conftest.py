import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
#: Columns that operators use within, to see that clashes don't matter.
EXTRA = ["size", "copies", "h", "k", "places", "marked", "rep", "score", "lang_pred", "links", "row", "n"]


def prose(rng, n, words=400):
    vocabulary = [f"w{i}" for i in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def near_copy(rng, text, changes=1):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def odd_rows():
    """Null, empty and blank texts, null ids, languages and sources, repeated rows and ids, ties, a very long text."""
    rng = random.Random(5)
    a, b, c = prose(rng, 120), prose(rng, 200), prose(rng, 90)
    passage = prose(rng, 60)
    rows = [
        (1, a, "en", "s1"), (2, a, "en", "s2"), (3, near_copy(rng, a), "en", "s1"), (4, b, None, None), (5, near_copy(rng, b, 2), "de", None),
        (6, c + " " + passage, "de", "s1"), (7, passage + " " + prose(rng, 80), "en", "s2"), (8, None, "en", "s1"), (9, "", "de", "s2"), (10, " \t\n\x0b ", "en", "s1"),
        (11, "one", "en", "s3"), (12, "one", "en", "s3"), (13, "four words are here", None, "s3"), (13, "four words are here", None, "s3"), (14, c, "de", "s1"), (14, b, "en", "s2"),
        (None, a, "en", "s1"), (None, None, None, None), (15, prose(rng, 20_000, 3000), "en", "s2"), (16, "a " * 300, "en", "s1"), (17, "ß漢字 😀 é\x85x\u00a0y " * 20, "de", "s4"), (18, "12 34 !! ??", "en", "s1"),
    ]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for name in EXTRA:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df.cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
