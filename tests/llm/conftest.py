import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, node long, rest string, score double"


def make_rows():
    """Small documents with every awkward case: nulls, blanks, ties, repeated rows, copies, shared passages, a long text, and columns with names the operators use."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    word = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = word(80), word(50)
    texts = [None, "", "  \n\t ", "One two", "one TWO", "é日本 <|endoftext|> it's  fine\n\n", base, base, base.upper(), base + " tail", "head " + base, base.replace(" ", "\n"), word(3000)]
    texts += [word(rng.randint(1, 60)) + " " + passage + " " + word(rng.randint(1, 60)) for _ in range(12)]
    near = base.split()
    for _ in range(14):
        copy = list(near)
        for k in rng.sample(range(len(copy)), rng.randint(1, 4)):
            copy[k] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += ["x " * 200, ("ab cd " * 30).strip(), "Released under the MIT License. " + word(20), word(30) + " Licensed under CC BY-NC 4.0."]
    texts += [word(rng.randint(0, 120)) for _ in range(25)]
    rows = [(i, t, "en", "s", None if t is None else len(t), "L", 7, "r", 0.5) for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    rows.append((None, base, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
