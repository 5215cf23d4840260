import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

pytest.importorskip("tidemark.llm.queries")

from tidemark.llm.tables import ship  # noqa: E402

SMALL, SF_DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Columns whose names the operators use inside.
CLASHING = ["id", "row", "h", "t", "m", "v", "ends", "stratum", "label", "kept", "n_words", "gone", "texts", "class", "score", "tokens"]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text) pairs, with clashing columns beside."""

    def make(pairs, lang="en"):
        rows = [(i, t, lang, "src", len(t or ""), *(f"own {c}" for c in CLASHING)) for i, t in pairs]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def edges():
    """Null and empty texts, a null id, blanks, repeated rows, ties, a very long text and one very long word."""
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"
    return [
        (1, None), (2, ""), (3, " \n\t "), (None, line), (4, line), (4, line), (5, line.upper()), (6, "word " * 60_000), (7, "x" * 150_000),
        (8, "é中😀 don't\u0085stop \x1c <|endoftext|> 12 !!"), (9, "\n\n" + line + "\n" + line + "\n\n"), (None, None), (10, "a b c"),
    ]


@pytest.fixture(scope="session")
def small(spark):
    """The smallest given documents, as a table and as rows."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    return df, df.collect()
