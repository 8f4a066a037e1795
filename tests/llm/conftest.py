import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def prose():
    """Random prose with copies, near copies, shared passages and odd rows: (doc_id, text)."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghiéß") for _ in range(rng.randint(1, 7))) for _ in range(400)] + ["The", "of", "and,"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [text(60) for _ in range(3)]
    docs = []
    for i in range(60):
        t = text(rng.choice([3, 10, 40, 120]))
        if rng.random() < 0.4:
            t = f"{t[: len(t) // 2]} {rng.choice(shared)} {t[len(t) // 2 :]}"
        docs.append(t)
    for i in range(25):  # copies and near copies
        w = docs[i].split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((" " if i % 2 else "\n").join(w))
    docs += [text(900), "a a a " * 50, "x " * 25, None, "", "  \n ", "one", "four words are here", "…!?"]
    rows = [(i, t) for i, t in enumerate(docs)]
    rows += [(7, docs[7]), (7, docs[7]), (8, "another text of the same id " * 8), (None, docs[3]), (None, None), (-5, docs[60])]
    rng.shuffle(rows)
    return rows


@pytest.fixture()
def frame(spark):
    def make(rows, parts=5):
        full = [(d, t, "en", "s", len(t or "")) for d, t in rows]
        return spark.createDataFrame(full, DOCS).withColumnsRenamed({}).repartition(parts)

    return make
