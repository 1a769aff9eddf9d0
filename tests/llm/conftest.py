import pytest

# Columns that share names with results and helpers of the operators.
CLASHES = "size long, shard int, slot long, n_words long, n_hit long, spans string, row long, key double, kept boolean, kinds string, n_entities long, src long, start long, pass int, items string, labels string, _t long, _d long"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Make a table of documents from (doc_id, text[, source]) rows, with clashing columns on request."""

    def make(rows, clashing=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if clashing:
            for column in CLASHES.split(", "):
                name, kind = column.split(" ")
                df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
        return df

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Null values, empty and blank texts, one word, a long text, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 5000}" for i in range(20_000))
    rows = [
        (1, None, None), (2, "", "a"), (3, " \t\n ", "a"), (4, "word", "a"), (5, long, "b"), (6, "same text here for all of us to read now", "a"),
        (6, "same text here for all of us to read now", "a"), (7, "same text here for all of us to read now", None), (None, "no id at all", "b"),
    ]
    return documents(rows, clashing=True)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
