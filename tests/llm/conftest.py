import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    """Documents from (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema)


def words(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Small documents with copies, near copies, a shared passage, nulls, empty and odd texts, a repeated row, one long text."""
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(5, 200)), f"s{i % 4}") for i in range(120)]
    passage = words(rng, 120)
    for i in range(120, 135):
        rows.append((i, f"{words(rng, 30)} {passage} {words(rng, 30)}", "s1"))
    for i in range(135, 150):
        near = rows[3][1].split()
        near[rng.randrange(len(near))] = f"x{i}"
        rows.append((i, " ".join(near), "s2"))
    rows += [(i, rows[7][1], "s0") for i in range(150, 158)]
    rows += [(200, None, "s0"), (201, "", None), (202, " \n\t ", "s3"), (203, "one", "s3"), (204, "ünïcödé 🙂 日本語", None), (None, "no id here at all", "s1"), (205, "twice the same row", "s1"), (205, "twice the same row", "s1")]
    rows.append((206, words(rng, 30_000), "s0"))
    rows.append((207, "ab" * 1500, "s0"))
    rows.append((208, "The same line again and again.\n" * 60, "s2"))
    return rows
