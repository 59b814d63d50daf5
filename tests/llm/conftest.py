import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import Scratch

#: Names that the operators use inside, as columns of the input.
CLASHING = [
    "id", "text_", "score", "label", "key", "line", "lines", "pos", "row", "removed", "n", "p", "token", "digest",
    "component_id", "component", "position", "positions", "size", "start", "target", "taken", "ids", "n_tokens", "intact", "v",
    "n_lines", "n_removed", "prefix", "source_key", "bucket", "rank", "path", "license", "first", "near", "times", "halves", "dim",
    "copies", "block", "unit", "term", "dir", "from_dir", "rep", "pivot", "s", "j", "b", "c", "g", "group", "_hot", "_salt",
]

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

LONG_TEXT = "\n".join(" ".join(f"w{(i * j) % 977}" for j in range(1, 40)) for i in range(2000)) + "x" * 50_000
PROSE = "the quick brown fox jumps over the lazy dog near the quiet river bank at dawn today"

ROWS = [
    (1, PROSE, "en", "a", 10),
    (2, PROSE, "en", "a", 10),
    (3, PROSE + " again", "en", "b", 10),
    (4, "", "en", "b", 0),
    (5, None, None, None, None),
    (6, "   \n\t\n ", "en", "b", 5),
    (7, LONG_TEXT, "en", "c", len(LONG_TEXT)),
    (8, "one", "en", "c", 3),
    (8, "one", "en", "c", 3),
    (None, "a document without an id at all, but with a text of its own", "en", None, 4),
]


@pytest.fixture(scope="session")
def documents_of(spark):
    """Makes documents of rows, with columns whose names operators use inside."""

    def make(rows, clashing=False):
        frame = spark.createDataFrame(rows, DOCUMENTS)
        return frame.withColumns({c: F.lit("x") for c in CLASHING}) if clashing else frame

    return make


@pytest.fixture(scope="session")
def odd_documents(documents_of):
    return documents_of(ROWS, clashing=True)


@pytest.fixture(scope="session")
def no_documents(documents_of):
    return documents_of([])


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")
