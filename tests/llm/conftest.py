import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 16) % len(WORDS)] + str((x >> 8) % 50))
    return " ".join(out)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns with names the operators use."""
    long = prose(5, 30000)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "One two three", None), (4, "one TWO three", "b"), (4, "one TWO three", "b"),
        (5, long, "b"), (6, long.upper(), "c"), (7, long + " end", "a"), (None, "One two three", "c"), (None, None, None),
        (8, prose(1, 200), "a"), (9, prose(1, 199) + " changed", "a"), (10, "É é  \n\n\n x", "b"), (11, "ab" * 600, "a"), (12, "one", "a"), (13, " \t ", "c"),
    ]
    rows = [(i, t, s, i, "x", 1, t, "k") for i, t, s in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row long, name string, n int, _lost string, kept string").repartition(4)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("1 = 0")
