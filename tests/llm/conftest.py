import random

import pytest

#: Texts with the cases that every operator must stand: null, empty, blank, very long, repeated, near copies, odd characters.
WORDS = [f"w{i}" for i in range(300)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    shared = sentence(rng, 70)
    rows = [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, sentence(rng, 30) + " " + shared),
        (8, shared + "\n" + sentence(rng, 40)),
        (9, "only three words"),
        (10, "Only THREE words"),
        (11, "é" * 300 + " ünïcödé \U0001f600 " + sentence(rng, 10)),
        (12, "x" * 5000),
        (13, sentence(rng, 6000)),
        (14, "line of text that comes again and again\n" * 40),
        (15, sentence(rng, 90)),
        (15, sentence(rng, 90)),
        (None, sentence(rng, 50)),
        (16, sentence(rng, 50)),
        (16, "<|endoftext|> is a mark <|x|>"),
        (17, "mail a.b@c.org, ip 10.0.0.1, card 4111 1111 1111 1111, call +1 (743) 555-3824"),
    ]
    return [*rows, rows[0]]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with further columns whose names operators use inside."""
    clashing = "node string, uid int, _id int, _spans string, _doc int, _rid int, _kept int, _hash int, shard int, spans int, sid int, hash int, part int, label int, row int"
    rows = [(i, t, "en", "s", None, *("u" if c.endswith("string") else 1 for c in clashing.split(", "))) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clashing}").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
