import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i}" for i in range(3000)]


def prose(start, n, step=1):
    """n words, different for different starts."""
    return " ".join(WORDS[(start * 37 + i * step) % len(WORDS)] for i in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text, source) rows; with columns that clash with inner names."""

    def build(rows, clash=True):
        df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DDL)
        if clash:
            from pyspark.sql import functions as F

            for n in ("body", "size", "shard", "node", "score", "key", "row", "group", "pattern", "owner", "bin", "members"):
                df = df.withColumn(n, F.lit("x"))
        return df

    return build


ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \t\n", None),
    (None, prose(1, 30), "b"),
    (5, prose(2, 40), "b"),
    (5, prose(2, 40), "b"),
    (6, prose(2, 40), None),
    (7, "É" * 10 + " " + prose(3, 20_000), "c"),
    (8, "x", "c"),
]


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empties, repeated rows, ties and a very long text."""
    return make(ODD)
