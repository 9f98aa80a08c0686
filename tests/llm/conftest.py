import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Small documents with copies, near copies, shared passages, nulls, empty, odd characters, long words and ties."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = say(90), say(150)
    near = long.split(" ")
    near[40] = "other"
    rows = [
        (5, say(40)),
        (1, f"{say(30)} {passage} {say(30)}"),
        (2, f"{say(10)}\n{passage}\t{say(5)}"),
        (9, long),
        (3, long),
        (4, " ".join(near)),
        (7, None),
        (8, ""),
        (10, "  \n "),
        (11, "one two"),
        (12, "la " * 60),
        (13, "x" * 1200 + " " + "é▁ñ" * 200),
        (14, "naïve café — it's  «quoted» text\n\n 123 4½ don't"),
        (None, long),
        (15, f"{passage} {say(3)}"),
        (16, say(200)),
        (16, "the same id again " + say(20)),
        (17, "repeated row " + passage),
        (17, "repeated row " + passage),
    ]
    return rows


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The texts with columns whose names the operators use themselves."""
    rows = [(i, t, "en", "src", None if t is None else len(t), 1.5, "x", 3) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, found string, bucket int").repartition(3)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
