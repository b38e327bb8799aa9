import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, ties, a long text, and columns named like the operators' own."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in a tall tower near the sea"
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base.replace(" ", "  "), "en", None),
        (4, base + " today", "en", "b"),
        (5, None, None, "b"),
        (6, "", "en", "b"),
        (7, " \n\t ", "en", "c"),
        (8, "two words", "en", "c"),
        (8, "two words", "en", "c"),
        (9, "x", None, None),
        (10, " ".join(f"word{i}" for i in range(30_000)), "en", "a"),
        (11, "Grüße aus Köln – 日本語 👩‍👩‍👧 ▁ end", "de", "a"),
        (None, "no id here at all", "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 as n", "2 as keep", "'k' as kept", "3 as rep", "4 as `__quality`", "5 as size", "6 as first", "7 as __digest", "8 as __id", "9 as __sha", "10 as _text", "11 as Shard", "12 as end")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
