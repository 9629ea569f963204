import pytest

LONG = "the quick brown fox and the lazy dog walked over to 12 houses in Berlin, " * 9
ODD = "doc_id long, text string, lang string, source string, n_chars long, kept string, words string, n_words int, fp string, h string, at string, kind string, z int, marks string, score string, length int, piece int, uid string, body string, rep string, _t string, rest string, n string"


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and long texts, ties, repeated rows, and columns with the names of results."""
    texts = [(1, LONG), (2, LONG), (2, LONG), (3, None), (4, ""), (None, LONG), (None, None), (5, " \t\n "), (6, "a"), (7, "Ünïcode 文字 ﬀ ́ <|endoftext|> 's 'll x" * 20), (8, "word " * 30_000), (9, LONG.upper()), (9, "other text under one id")]
    rows = [(i, x, "en" if k % 3 else None, "s", 1, *["clash"] * 2, 1, *["clash"] * 4, 1, *["clash"] * 2, 1, 1, *["clash"] * 6) for k, (i, x) in enumerate(texts)]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
