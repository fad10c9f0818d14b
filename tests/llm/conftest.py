import random

import pytest

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=5, n=60):
    """Texts with copies, near copies, shared passages, nulls, blanks, odd characters and one long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgéü") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passage = " ".join(r.choice(vocab) for _ in range(70))
    rows = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(0, 120))]
        kind = r.random()
        if rows and kind < 0.2:
            words = (r.choice(rows)[1] or "").split(" ")
        elif rows and kind < 0.5:
            words = (r.choice(rows)[1] or "").split(" ")
            for _ in range(r.randint(1, max(1, len(words) // 20))):
                words[r.randrange(len(words))] = r.choice(vocab).upper()
        elif kind < 0.7:
            at = r.randint(0, len(words))
            words[at:at] = passage.split(" ")
        text = " ".join(words)
        if r.random() < 0.2:
            text = text.replace(" ", "\t\n ", 3)
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["s0", "s1", "s2", None]), len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (n + 2, " \t\n", "en", "s1", 3), (n + 3, " ".join(r.choice(vocab) for _ in range(4000)), "en", "s9", 1), (n + 4, "one two", "en", "s0", 7), (n + 5, "ONE two", "en", "s0", 7), (n + 6, "\U0001f600 \x85 \xa0 x \x00 y" + passage, "fr", "s0", 9)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Null ids, repeated rows and extra columns whose names operators use inside."""
    more = [rows[3], rows[3], (None, rows[3][1], "en", "s0", 1), (None, None, None, None, None), (None, "x", "en", None, 1)]
    df = spark.createDataFrame([*rows[:12], *more], SCHEMA)
    for c in ("_size", "_shard", "_uid", "node", "size", "kind", "blob", "spans", "_node", "component_id", "_copies", "_kept", "_spans", "_lang_pred", "rules", "part"):
        df = df.withColumn(c, F.lit("own"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
