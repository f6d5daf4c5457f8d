import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def invented(rng, n):
    syllables = "the an er on re in th ha ou es".split()
    out, left = [], 0
    for _ in range(n):
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        if left == 0:
            w, left = w.capitalize(), rng.randint(3, 14)
        left -= 1
        out.append(w + ("." if left == 0 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def prose():
    return invented


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(5)
    plain = invented(rng, 60)
    long = invented(rng, 30_000)
    rows = [
        (0, plain, "en", "a", len(plain)),
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, " \t\n\x0b\x0c\r ", "en", "b", 7),
        (4, long, "en", "b", len(long)),
        (5, plain, "en", "a", len(plain)),
        (5, plain, "en", "a", len(plain)),
        (6, plain + " tail", "de", "c", len(plain) + 5),
        (None, plain, None, None, None),
        (None, None, None, None, None),
        (7, "word", "en", "", 4),
        (8, "Öß 日本 🙂  double  spaces\n\n\nlines İstanbul", "en", "c", 40),
        (-3, invented(rng, 12), "en", "c", 50),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """Those rows with more columns, named like the operators' own."""
    import pyspark.sql.functions as F

    df = spark.createDataFrame(odd_rows, DOCS)
    names = "size hash key copies threshold n fp keep doc stats rule body same runs n_sentences n_removed removed piece score family".split()
    return df.withColumns({c: F.lit(1) for c in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(9)] + [(None, 1, 0), (3, None, None), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
