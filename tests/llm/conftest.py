"""Small texts with the cases every corpus operator has to stand."""

import random

import pytest

WORDS = "the of and to in is that it was for on are as with be at by this from or".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(f"{draw.choice(WORDS)}{draw.randint(0, 60)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Null id, text, source; empty, very long and repeated texts; repeated rows; a column with a clashing name."""
    base = prose(1, 120)
    words = base.split()
    rows = [
        (1, base, "a", 0),
        (2, base, "a", 1),
        (3, " ".join([*words[:60], "changed", *words[61:]]), None, 2),
        (4, None, "a", 3),
        (5, "", "b", 4),
        (6, "word", "b", 5),
        (7, prose(2, 30_000), "a", 6),
        (8, "Ünïcode \t\x0b text\r\nwith 中文 ☃ and\x1cmore", "b", 7),
        (9, " \n\t ", None, 8),
        (10, prose(3, 80) + "\n" + prose(3, 80), "b", 9),
        (10, prose(3, 80) + "\n" + prose(3, 80), "b", 9),
        (None, base, "a", 10),
        (None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score long")


@pytest.fixture(scope="session")
def no_docs(awkward):
    return awkward.limit(0)
