import random

import pytest

SCHEMA = "doc_id long, text string, mark string, `a.b` int, pieces int, n_lines int"
WORDS = ["the", "of", "Ähre", "señor", "an", "to", "x1", "für", "naïve", "die", "in", "que"]


def passage(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(n))


def edge_rows():
    """Nulls everywhere, empty and blank texts, a long text, ties, copies, shared passages."""
    a, b = passage(1, 60), passage(2, 40)
    texts = ["", None, "   \n\t ", "one", "One", "two words", "a b c", a, a, a + " tail", "head " + a,
             b + "\n" + a, b.replace(" ", "\n"), b.replace(" ", "\n") + "\nend", b.upper(),
             "\n".join([passage(9, 12), "", "", "x"] * 6), passage(3, 30_000), "日本語 😀 é " * 30,
             "\x00 nul \x1c byte", passage(4, 13), passage(4, 13) + " " + passage(5, 12)]
    rows = [(i, t, "m", i, None, 3) for i, t in enumerate(texts)]
    rows += [(7, a, None, None, None, None), (7, a, None, None, None, None),
             (None, a, None, 1, 2, 3), (None, None, None, None, None, None),
             (None, "no id here", "z", 1, 1, 1), (-5, a + "\n" + b, "neg", 0, 0, 0)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from sparkrag.session import ship_package
    ship_package(spark)


@pytest.fixture(scope="session")
def some_docs(spark):
    """A few hundred of the driver's documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
