import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "size bigint, `rank` string, bucket string, `k` int")


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names also occur inside the operators."""
    def run(rows):
        return spark.createDataFrame(
            [(i, t, "en", s, 0, -1, "r", "b", 7) for i, t, s in rows], SCHEMA)
    return run


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and white texts, ties, repeated rows and one very long text."""
    text = " ".join(f"word{i % 97} and the number {i}." for i in range(40))
    return make([(1, text, "a"), (2, text, "a"), (2, text, "a"), (3, None, "a"), (4, "", None),
                 (5, " \t\n\x0b\x0c\r ", None), (None, text + " tail", "b"), (None, None, None),
                 (7, "one two", ""), (8, "x" * 300_000, "a"), (9, "the cat sat. " * 20_000, "a"),
                 (9, "another text with doc id nine", "b")])


@pytest.fixture(scope="session")
def none(make):
    return make([]).where("false")
