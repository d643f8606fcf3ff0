import pytest

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, n_words string, "
        "fp string, key string, kind string, base string, score string, term string, "
        "rule string, words string, component string, trusted string")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names the operators use inside."""
    def make(rows):
        extra = ("x",) * (len(DOCS.split(",")) - 5)
        return spark.createDataFrame(
            [(i, t, lang, "s", len(t) if t is not None else None, *extra)
             for i, t, lang in [(*r, "en")[:3] if len(r) == 2 else r for r in rows]], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white-space texts, repeated rows, signs, one long text."""
    long = " ".join(f"word{i % 997} Ünïcode{i % 89}," for i in range(40_000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "same text here, the same text"),
            (4, "same text here, the same text"), (5, "same text here, the same text"),
            (None, "no id at all in this row"), (7, "?! ### ..."), (8, long), (9, "é"),
            (10, "line one\nline two\n\nline one\n")]
