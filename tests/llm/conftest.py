import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A frame of texts with ids 0, 1, ... or of given (id, text) rows, over several partitions."""

    def make(texts, parts=3, extra=None):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
        frame = frame.repartition(parts) if rows else frame
        return frame.selectExpr("*", *(extra or []))

    return make


def words(seed, n, size=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture
def hard_texts():
    """Null, empty, blank, short, long, repeated and near texts, and text outside ASCII."""
    base = words(1, 300)
    near = list(base)
    near[150] = "other"
    long = " ".join(words(2, 30_000, 5000))
    return [None, "", " \n\t", "one", "One", " ".join(base), " ".join(base), " ".join(near), "\n".join(base), long, "é ñ 漢字 " * 60, "same line here now\n" * 50, " ".join(words(3, 200)) + " " + " ".join(base[20:90])]
