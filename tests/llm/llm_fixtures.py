import random

import pytest

CLASH = ["twin", "print", "hash", "at", "n", "word", "words", "label", "score", "line", "first", "node", "block", "kept", "spans", "removed", "ids", "kind", "_d", "_removed"]


def prose(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice(['w', 'Ge', 'lo', 'éa'])}{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with every kind of odd row, columns whose names clash, and (rows, frame)."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [t + " end" for t in texts[:10]] + texts[10:20]  # near and exact copies
    passage = prose(rng, 70)
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, rng.randint(0, 40)) for _ in range(8)]
    texts += [None, "", " \t\n ", "a" * 20_000, prose(rng, 6000), "x y\n\nx y\ny x\n\tx\ty", "same " * 300, None]
    rows = [(i, t, None if i % 7 == 0 else ("en", "fr")[i % 2], "s") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], "en", "s"), (5_000, texts[4], None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in CLASH:
        frame = frame.selectExpr("*", f"cast(1 as double) as {name}")
    return rows, frame.repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy[1].limit(0)
