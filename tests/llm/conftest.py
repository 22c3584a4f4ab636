import random

import pytest

WORDS = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyzäéñ", k=random.Random(i + 999).randint(2, 9))) for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Texts with copies, near copies, shared passages, repeats inside a text, and nothing at all."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 300)) for _ in range(60)]
    passage = prose(rng, 70)
    rows = list(base)
    rows += [base[3], base[3], base[7].upper(), base[8] + " tail"]
    near = base[10].split(" ")
    for k in range(6):
        edited = list(near)
        edited[k % len(edited)] = "edited"
        rows.append(" ".join(edited))
    rows += [f"{prose(rng, 20)} {passage} {prose(rng, 9)}" for _ in range(7)]
    rows += [f"{passage}\n{passage}", "x" * 950, "ab" * 400, "", None, "   \n\t ", "one", "two words", "é" * 300 + base[1], "é" * 300 + base[2]]
    return [(i * 3 + 1, t, "xx", "s", 0) for i, t in enumerate(rows)]


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The corpus with columns whose names the operators use themselves."""
    extra = "sha string, starts string, component string, kept string, hash string, text string"
    frame = spark.createDataFrame([(i, t, *"abcde") for i, t, *_ in texts], "doc_id long, body string, " + extra.rpartition(",")[0])
    return frame.withColumnRenamed("body", "text").repartition(3)


@pytest.fixture
def empty(docs):
    return docs.where("false")


@pytest.fixture
def odd(spark):
    """Nulls in every column, a repeated row, and a repeated doc_id with another text."""
    return spark.createDataFrame([(None, None), (None, "word " * 80), (1, None), (2, "alpha beta " * 60), (2, "alpha beta " * 60), (3, "gamma delta " * 60), (3, "other text"), (4, "")], "doc_id long, text string")


