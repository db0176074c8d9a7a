import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_hash string, token string, sketch int"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, blanks, ties, repeated rows and ids, a very long text, and columns with clashing names."""
    from tidemark.llm.common import prepare

    prepare(spark)
    base = " ".join(f"word{i}" for i in range(120))
    long = " ".join(f"l{i % 977}x{i}" for i in range(20000))
    texts = [(1, base), (2, base + " end"), (3, base), (3, base), (4, None), (5, ""), (6, " \n "), (7, "one two"), (8, "one two"), (None, base), (None, "lone words here"), (9, long), (10, "é" * 150 + base), (11, "\\ <| a </s>"), (12, "x " * 60)]
    return spark.createDataFrame([(i, t, None, "s", None, "h", "t", 1) for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
