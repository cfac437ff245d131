import pytest

LONG_WORDS = 30_000

#: doc_id, text, lang, source, n_chars and columns whose names clash with results of operators.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, shard string, score string, ids string, "
          "fingerprint string, copy string, place string, ghost string, bin string, words string, pii_spans string")


def row(doc_id, text, lang="en", source="src0"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["clash"] * 10)


LONG = " ".join(f"word{i % 700} and the" for i in range(LONG_WORDS // 3))

EDGE_ROWS = [
    row(1, "The quick brown fox jumps over the lazy dog and runs to the river bank every morning."),
    row(2, "The quick brown fox jumps over the lazy dog and runs to the river bank every morning."),  # exact copy
    row(3, None), row(4, ""), row(5, " \t\n "), row(6, None, None, None),
    row(7, LONG), row(8, "a"), row(9, "x" * 50_000), row(10, "1" * 20_000 + " " + "." * 5_000),
    row(None, "no id here but the text is of some length and it has words"),
    row(None, None, None, None),
    row(11, "same id twice"), row(11, "same id twice"), row(11, "same id, other text"),
    row(12, "Der Hund und die Katze sind in dem Haus und nicht auf der Straße", "de", "src1"),
    row(13, "日本語のテキスト \U0001f600 é́  ", "ja", "src2"),
    row(14, "line\nline\nline\n\nother", "en", None),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
