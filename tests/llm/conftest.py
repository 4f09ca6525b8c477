import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empties, white space, repeated rows, ties, near copies, a long text, and clashing extra columns."""
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w59", "other")
    far = " ".join(f"v{i}" for i in range(60))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, far, "de", None), (5, None, None, "b"), (6, "", "en", "a"), (7, " \t\n ", "en", "b"),
        (8, "one two", "fr", "c"), (9, "one two", "fr", "c"), (10, "Ünï ΑΣ <|endoftext|> 12!!", "de", None), (11, (base + "\n") * 40, "en", "a"), (11, (base + "\n") * 40, "en", "a"),
    ]
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars int, sig string")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
