import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, component_id string, score string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) with columns whose names clash with those of results."""

    def make(rows, lang="en", source="s"):
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "x", "y", "z") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeats, one very long text, near copies."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(220)
    near = base.split()
    near[50] = near[120] = "changed"
    passage = text(60)
    rows = [
        (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one"), (5, "One"), (6, "two words"), (7, base), (8, base), (9, " ".join(near)), (10, base.upper()),
        (11, text(40) + " " + passage + " " + text(30)), (12, passage + " " + text(50)), (13, "été " * 40), (14, "\n".join([text(12)] * 5)), (15, "1234 5678"), (16, text(30000)), (17, "\U0001f600 " * 3),
    ]
    group = text(150).split()
    for i in range(30):  # a hot group of near copies
        w = list(group)
        w[rng.randrange(150)] = f"v{i}"
        rows.append((100 + i, " ".join(w)))
    return rows + [(200 + i, text(rng.randrange(1, 120))) for i in range(40)]
