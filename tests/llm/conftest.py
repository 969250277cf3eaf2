import pytest

#: Null, empty, blank, tied, repeated, odd and long texts; ids with a null and a repeated one.
EDGES = [
    (3, "alpha beta  gamma\t\tdelta \n epsilon"), (1, None), (2, ""), (5, "   "), (7, "alpha beta  gamma\t\tdelta \n epsilon"),
    (9, "x"), (9, "x"), (None, "no id at all"), (11, "it's 12 o'clock; éß你好 \U0001f600‍\U0001f600 <|endoftext|>    x\u0085 y\x1c z"),
    (12, "long " * 4000 + "tail"), (13, "a\n\nb\r\n c"), (14, "!" * 300),
]


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, 2.0, "k") for i, t in EDGES]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, ids int, score double, mark string"
    )


@pytest.fixture(scope="session")
def nothing(spark, edges):
    return spark.createDataFrame([], edges.schema)
