import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc string, score string, kept string, component string, mx_size string, qr_kept string"


def prose(r: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{r.randint(0, words)}" + r.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows and ids, and extra columns with clashing names."""
    r = random.Random(3)
    base = prose(r, 60)
    texts = [None, "", "  \n\t ", "one", "two words", base, base, base + " end", prose(r, 30), prose(r, 9000, 5000), "x" * 50_000, "\x1c\x85 \xa0é", base.upper(), "a\n\na\na"]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[8], (None, base, "en", "s1", 1), (None, None, None, None, None)]
    return [(*x, "d", "s", "k", "c", "m", "q") for x in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
