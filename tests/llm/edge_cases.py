import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, size string, _n int"

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
STUTTER = " ".join(f"u{i}" for i in range(3000)) + " same" * 6000

EDGE = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "s1"),
    (2, None, "en", "s1"),
    (3, "", None, "s2"),
    (4, " \t\n\x0b ", "fr", None),
    (5, "one two", "en", None),
    (6, "one two", "en", "s1"),
    (7, LONG, "en", "s2"),
    (8, PASSAGE + " tail of eight", "de", "s2"),
    (9, "head of nine " + PASSAGE, "de", "s1"),
    (10, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "s3"),
    (10, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "s3"),
    (11, "été déjà vu 中文 😀 €5 ▁ x y don't it's 1234", "fr", "s3"),
    (None, "no id at all here but some words", "en", "s1"),
    (13, STUTTER, "en", "s4"),
    (12, "a a a a a a a a a a a a a a a a a a a a", "en", "s4"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows,
    and columns whose names clash with results."""
    rows = [(*r, None, "clash", "clash", "clash", 7) for r in EDGE]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
