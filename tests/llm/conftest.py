import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:  # names that operators may use themselves
            from pyspark.sql import functions as F

            for name in ("row", "doc", "id", "key", "kept", "rest", "spans", "words", "lines", "first", "n", "word", "component", "digest", "host", "text_sha256", "length", "shard", "nth", "rank", "score", "signature", "a", "b"):
                df = df.withColumn(name, F.lit("x"))
        return df.repartition(3)

    return make


WORDS = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were".split()


def prose(seed, n=120, words=WORDS):
    import random

    r = random.Random(seed)
    made = [r.choice(words) + (str(r.randrange(1000)) if r.random() < 0.5 else "") for _ in range(n)]
    return " ".join(made)


#: Null ids and texts, white space of all kinds, ties, repeated rows and a very long text.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\f\r"), (4, "one"), (5, "one  two\n"), (6, "one two "), (6, "one two "), (7, "one\ttwo three"), (None, "one two three"), (None, None), (8, "É ñ ß 漢字 😀  x"),
    (9, "word " * 30000), (10, "x" * 100_000), (11, prose(1)), (12, prose(1)), (13, prose(1) + " more"), (13, prose(2)), (14, "\x00 \x1c nul"),
]
