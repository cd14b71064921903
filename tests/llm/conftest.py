import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi "
         "psi omega one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
         "seventeen eighteen nineteen twenty red green blue black white grey pink brown gold silver north south east west")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = [(1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, None, None, None, None),
            (4, "", "en", "b", 0), (5, " \t\n ", "de", "b", 3), (None, "lone words here", None, None, None),
            (6, "short", "de", None, 5), (7, "x " * 30_000, "en", "a", 60_000), (8, PROSE.upper(), "fr", "c", 1)]
    df = spark.createDataFrame(rows, COLUMNS)
    extra = {c: df["n_chars"] for c in ("id", "t", "k1", "fp", "shard", "size", "key", "tokens", "p", "w", "h", "at", "topic")}
    return df.withColumns(extra)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
