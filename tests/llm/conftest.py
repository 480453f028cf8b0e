import pytest

# Texts that every text operator must handle: nulls, empties, no words, ties, repeats,
# long texts, long runs, other scripts.
EDGE_TEXTS = [
    None, "", " \n\t", "one", "two words", "a b c d", "the cat sat on the mat " * 30, "x" * 5000, "été ÉTÉ naïve",
    "привет мир", "line one\nline one\n\nline two\nline one", "# * $ % & | < > #",
    "the cat sat on the mat " * 30, "word " * 3000, "\x0b\x0c mixed space", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The edge texts as documents, with a null id, repeated rows and clashing columns."""
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "clash", 1.5) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[6], rows[1], (None, "a null id has a text of its own, quite short", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "N_WORDS string, Kept double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def smoke_dir():
    return "/root/testdata/sf0.001"
