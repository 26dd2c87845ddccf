import pytest

#: Rows that every operator must bear: nulls, empty, blank, a very long text, repeats.
LONG = " ".join(f"word{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "xx", "", 4),
        (None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
        (5, LONG, "en", "b", 1),
        (6, LONG, "en", "b", 1),
        (6, LONG, "en", "b", 1),
        (7, "short", "en", "b", 5),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("n_words", "size", "copies", "taken", "target", "kept", "block", "payload", "h1", "labels", "score", "row", "cluster", "s", "b", "_block")
    return awkward.select("*", *(F.lit("x").alias(n) for n in names))
