import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names clash with the operators' own."""

    def build(rows):
        data = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(data, SCHEMA)
        for name in ("key", "pos", "fp", "size", "score", "words", "at", "n", "bucket", "start", "root"):
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Null, empty, blank, very long, tied, repeated and accented texts, and a null id."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (5, None), (3, ""), (9, " \t\n"), (4, long), (8, long + " tail"), (1, "one"), (2, "one"), (7, "Ünï cödé wörds – and 漢字"),
        (7, "Ünï cödé wörds – and 漢字"), (11, "a b c\u0085d \x0b e"), (None, "no id"), (12, "the end"),
    ]
    return make(rows)
