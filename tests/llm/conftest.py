import pytest

#: Nulls, empty and long texts, repeated rows, ties.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog while the band plays on and on tonight.\nshort\nAnother Line"),
    (2, None),
    (3, ""),
    (None, "no id here, only text 4111 1111 1111 1111"),
    (5, "  the QUICK brown fox jumps over the lazy dog while the band plays on and on tonight. \nélan"),
    (5, "  the QUICK brown fox jumps over the lazy dog while the band plays on and on tonight. \nélan"),
    (7, "word " * 5000),
    (8, " \t\n \x0b"),
    (9, "a\n\na\nb"),
    (-4, "The quick brown fox jumps over the lazy dog while the band plays on and on tonight."),
    (11, "x" * 3000 + " 日本語 テスト ½² don't"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


@pytest.fixture(scope="session")
def crowded(spark):
    """The same rows beside columns whose names operators use themselves."""
    names = ["h1", "gone", "n_lines", "kept_text", "_pii", "slot", "place", "row_no", "fp", "component_id", "length", "failed_rules", "_row"]
    rows = [(*r, *range(len(names))) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
