import pytest


@pytest.fixture
def documents(spark):
    """Awkward rows: NULLs, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long_text = " ".join(f"word{i % 977} tail{i % 13}" for i in range(30_000))
    rows = [
        (1, "Plain words make a line.", "en", "a", 24),
        (2, None, "en", "a", None),
        (3, "", None, "a", 0),
        (4, " \t\n ", "en", None, 4),
        (5, long_text, "de", "b", len(long_text)),
        (6, "Plain words make a line.", "en", "a", 24),
        (6, "Plain words make a line.", "en", "a", 24),
        (None, "Without an id.", "en", "b", 14),
        (8, "é ü 漢字 \U0001f600 <|endoftext|> x", "xx", "b", 30),
        (9, "one", "en", "a", 3),
        (10, "one two", "en", "a", 7),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def clashing(documents):
    """The same rows with columns that operators might want to call their own."""
    names = ("spans", "score", "predicted", "kept", "low", "print", "_print", "_row", "_text", "_lang", "size", "shard", "sequence_id", "n_words", "ids", "component_id")
    return documents.selectExpr("*", *[f"concat('{n}-', n_chars) AS `{n}`" for n in names])


@pytest.fixture(scope="session")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def tokenizer(tokenizer_path):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_path)
