import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{k % 977}x{k % 31}." for k in range(30_000))
PARAGRAPH = "the quick brown fox jumps over the lazy dog while seven wise men talk about the weather and the long road home to the sea"

ROWS = [
    (0, None, None, None), (1, "", "en", "a"), (2, "   \n\t ", "en", "a"), (3, "One word", "de", "b"), (4, LONG, "en", "a"), (5, LONG, "en", "a"), (6, PARAGRAPH, "en", "a"),
    (7, PARAGRAPH.upper(), "en", None), (8, PARAGRAPH + " extra", "en", "a"), (9, "line\nline\nline\n" * 40, "fr", "c"), (10, "Größe und Maß: ÄÖÜ <|endoftext|> éè 中文 🙂" * 3, "de", "b"), (11, "x" * 5000, "xx", "c"),
    (12, "a b c d e f g h " * 20 + "$$$ ### |||", "en", "a"), (6, PARAGRAPH, "en", "a"), (13, "Released under the MIT License.", "en", "b"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names the operators use themselves."""
    names = "doc_id long, text string, lang string, source string"
    clash = ", n_chars long, kept string, n_words int, id int, body string, h string, label int, row int, _m int, words int, a int"
    schema = T._parse_datatype_string(names + clash)
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y", "z", 4, 5, 6, 7, 8) for r in ROWS], schema).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
