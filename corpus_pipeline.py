"""A corpus pipeline of five stages over ``documents``, each by one document operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next one's docs. A stage
sees all that its predecessor kept; all but the last return the columns of
``documents``, extra ones with any name as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlake.llm.bpe import encode_documents
from revlake.llm.common import materialise, read_table
from revlake.llm.decontaminate import decontaminate
from revlake.llm.neardup import deduplicate
from revlake.llm.secrets import redact
from revlake.llm.toxicity import without_toxic
from revlake.plans.shipping import shipped


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the operator's threshold. A null or empty text
    is scored like one that fires no voter; without labels hand-written voters work alone.
    Repeated rows and rows without an id are scored each; an empty table stays empty."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the least id, or of the
    first row where ids repeat or are missing. Documents without words (null, empty) are
    linked with nothing and stay; an empty table stays empty."""
    return deduplicate(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two or more benchmark items go; of the others, hit words are
    cut out. Null and empty texts, and all texts if the benchmark is empty, have no hits."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets in its text replaced by a mark; null texts stay null."""
    return redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens, and hashes of the ids and of the text decoded from them,
    for every document, repeated rows and rows without an id included; a null text is an empty one."""
    return encode_documents(docs, outputs=("ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", shipped(drop_toxic)),
    ("near duplicates", shipped(drop_near_duplicates)),
    ("decontamination", shipped(remove_benchmark)),
    ("secrets", shipped(redact_secrets)),
    ("tokens", shipped(encode)),
]

#: No SQL states the classifier or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
