import random

import pytest

WORDS = ["the", "of", "and", "river", "stone", "bright", "under", "garden", "walks", "seven", "paper", "house", "green", "light", "over", "small"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) if rng.random() < 0.7 else rng.choice(WORDS) for _ in range(n))


def awkward_rows():
    """Nulls, empty and blank texts, repeated rows, a null id, long texts and copies."""
    base = prose(1, 120)
    rows = [(i, prose(100 + i, 30 + 5 * i)) for i in range(12)]
    rows += [(20, base), (21, base), (22, base + " tail"), (23, None), (24, ""), (25, " \n\t "), (26, "one"), (27, "one two")]
    rows += [(28, "x " * 300), (29, prose(9, 4000)), (30, "no break café \U0001f44d"), (20, base), (None, prose(77, 60)), (None, base)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows, with further columns whose names clash with internal ones."""
    rows = [(i, t, "en" if (i or 0) % 2 else None, "s", None, 1, "p", 5, True) for i, t in awkward_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, doc long, part string, key long, removed boolean")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")
