import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Null, empty, blank, tiny, long, repeated and clashing rows."""
    rows = [
        (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "ONE  two"), (5, "a b c d e f g h i j k l"), (6, "a b c d e f g h i j k l"), (None, "no id at all, none"),
        (7, "Ünïcödé 日本語 😀 text's end"), (8, "x" * 3000), (9, "word " * 2000), (10, "\ud7ff\ufffd\x1c\x85"), (11, "123 456"), (11, "123 456"),
    ]
    return spark.createDataFrame([(i, t, "en", "score", 1.0, 2) for i, t in rows], "doc_id long, text string, lang string, source string, score double, kept int")
