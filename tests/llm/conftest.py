import random

import pytest


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, repeated, long and clashing columns."""
    long = words(1, 9000)
    rows = [(0, None, "s"), (1, "", "s"), (2, " \n\t ", None), (3, long, "s"), (3, long, "s"), (4, "Ab c", "t"), (None, "ab C", "t"), (5, "ab c", None), (6, "é 漢字 \x85 x y <|endoftext|>", "t"), (7, "a " * 5000, "s")]
    return spark.createDataFrame([(i, t, s, 1, "clash", "f", 0) for i, t, s in rows], "doc_id long, text string, source string, piece int, feature string, row string, size long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
