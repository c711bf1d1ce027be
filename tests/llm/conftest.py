import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, n long, key string, label int, "
    "node string, component string, items string, mix_slot long"
)


def table(spark, rows):
    """Documents of (doc_id, text[, lang, source]) with columns whose names the operators use inside."""
    full = []
    for r in rows:
        r = (*r, *[None] * (4 - len(r)))
        full.append((*r, len(r[1]) if r[1] is not None else None, 7, 7, "k", 1, "x", "y", "z", 5))
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture
def make(spark):
    return lambda rows: table(spark, rows)


@pytest.fixture(scope="session")
def prose():
    """Near copies, exact copies, shared passages, junk, nulls and a long text, in a fixed order."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) + rng.choice(["", "", "", ".", ","]) for _ in range(n)]
    passage = " ".join(words(60))
    texts = []
    for _ in range(40):
        base = words(rng.randrange(30, 120))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            near = list(base)
            for _ in range(rng.randrange(1, 5)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
        if rng.random() < 0.3:
            at = rng.randrange(len(base))
            texts.append(" ".join(base[:at]) + " " + passage + " " + " ".join(words(40)))
    base = words(80)
    for k in range(30):  # a dense region: every pair is near the threshold
        near = list(base)
        for _ in range(rng.randrange(2, 6)):
            near[rng.randrange(len(near))] = f"edit{k}x{rng.randrange(9)}"
        texts.append(" ".join(near))
    texts += [texts[0]] * 5 + ["", " \n\t ", None, None, "one", "One", "one two", "a b c d", "A  b\tc d", "é É", " ".join(words(4000))]
    return list(enumerate(texts))
