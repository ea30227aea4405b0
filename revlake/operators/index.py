"""An inverted index of key trigrams, substring search through it, and edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(column: str | Column, n: int = GRAM) -> Column:
    """All substrings of ``n`` characters; a shorter string is its own only gram."""
    c = F.col(column) if isinstance(column, str) else column
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (n - 1))), lambda i: F.substring(c, i, F.lit(n)))


def postings(keys: DataFrame) -> DataFrame:
    """(gram, key) once each."""
    return keys.select(F.explode(F.array_distinct(grams("key"))).alias("gram"), "key")


def build(keys: DataFrame) -> DataFrame:
    """The index as rows: gram, key, and n, how many keys have the gram. A frequent gram is many rows, not one long one."""
    rows = postings(keys)
    return rows.join(rows.groupBy("gram").agg(F.count("*").alias("n")), "gram").select("gram", "key", "n")


def contains(index: DataFrame, keys: DataFrame, pattern: str) -> DataFrame:
    """Keys that contain ``pattern``: those in the postings of all its grams, verified.
    A pattern shorter than a gram scans the keys."""
    if len(pattern) < GRAM:
        return keys.filter(F.col("key").contains(pattern))
    wanted = sorted({pattern[i : i + GRAM] for i in range(len(pattern) - GRAM + 1)})
    hits = index.filter(F.col("gram").isin(wanted)).groupBy("key").agg(F.countDistinct("gram").alias("n")).filter(F.col("n") == len(wanted))
    return hits.filter(F.col("key").contains(pattern)).select("key")


def complete(keys: DataFrame, typed: str, most: int = 50) -> DataFrame:
    """The best completions: prefix matches first, then by edit distance, then by name."""
    rank = F.when(F.col("key").startswith(typed), 0).otherwise(1)
    scored = keys.select("key", rank.alias("rank"), F.levenshtein("key", F.lit(typed)).cast("long").alias("distance"))
    return scored.orderBy("rank", "distance", "key").limit(most)
