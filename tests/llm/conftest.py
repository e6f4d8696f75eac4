import pytest

# names that operators use inside, and columns of the given table
CLASHING = "lang string, source string, n_chars long, score double, node long, label int, rank long, slot int, part int, kept boolean, words string, host string"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents table of (doc_id, text) pairs with further columns of clashing names."""
    def make(rows):
        extra = ("en", "src0", 1, 0.5, 1, 1, 1, 1, 1, True, "w", "h")
        return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {CLASHING}")
    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls, empty and very long texts, ties and repeated rows."""
    return documents([
        (1, "The quick brown fox jumps over the lazy dog."), (1, "The quick brown fox jumps over the lazy dog."),
        (2, None), (3, ""), (4, " \n\t "), (None, "no id here"), (None, None), (5, "x" * 20_000), (6, "word " * 30_000),
        (7, "ÀÉß ﬁ ½ 日本 😀 <|endoftext|> don't"), (8, "The quick brown fox jumps over the lazy dog."),
    ])


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
