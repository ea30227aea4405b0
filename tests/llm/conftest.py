import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tests_llm_rows import DOC, texts  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, None if i == 2 else "en", None, None if t is None else len(t)) for i, t in texts()]
    return spark.createDataFrame(rows, DOC)


#: Names that the operators use inside.
CLASHING = (
    "_row", "row", "doc", "key", "hash", "rep", "id", "of", "first", "group", "comp", "cid", "n", "n_chars_", "path", "sig", "members", "component",
    "score", "held", "held_out", "predicted", "posterior", "counts", "votes", "y", "x", "t", "s", "v", "k", "h", "c", "e",
    "hits", "items", "unnamed", "n_words", "spans", "base", "found", "present", "start", "end", "kind", "copies", "chosen",
)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns, of text, whose names the operators use inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def odd(spark, clashing):
    """Clashing columns, repeated rows, several rows without an id, and texts of more than a MiB."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i * 7919 % 300007}" for i in range(180_000))
    longer = clashing.filter("doc_id = 0").withColumns({"doc_id": F.lit(30).cast("long"), "text": F.lit(long), "n_chars": F.lit(len(long)).cast("long")})
    copy = longer.withColumn("doc_id", F.lit(31).cast("long"))
    nameless = clashing.filter("doc_id in (6, 12, 18)").withColumn("doc_id", F.lit(None).cast("long"))
    rows = clashing.union(clashing.filter("doc_id in (0, 6, 3)")).union(longer).union(copy).union(nameless).union(nameless)
    return spark.createDataFrame(rows.collect(), rows.schema)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
