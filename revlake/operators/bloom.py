"""Bloom filters of runs as rows of 64-bit words, built and probed with native functions.

Bit j of a key is (FNV-1a + j * checksum) modulo the run's bits, as many bits a key as
asked for and the number of hashes that is best for them.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.functions import scalars as fn

BITS = 10


def _bits(keys: DataFrame, per_key: int) -> DataFrame:
    """A row for each hash of each key: word and bit in its run's filter of m bits."""
    hashes = max(1, round(per_key * log(2)))
    with_hashes = keys.withColumns({"h1": fn.fnv1a(F.col("key")), "h2": fn.checksum_column(F.col("key"))})
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda j: F.pmod(F.col("h1") + j * F.col("h2"), F.col("m"))))
    return with_hashes.select("run", "key", "m", at.alias("at")).select("run", "key", "m", F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))


def build(keys: DataFrame, per_key: int = BITS) -> DataFrame:
    """Filters of ``keys`` (run, key): run, m, word, bits; words without a bit have no row."""
    keys = keys.select("run", "key").distinct()
    sizes = keys.groupBy("run").agg(F.greatest(F.lit(64), F.count("*") * per_key).alias("m"))
    return _bits(keys.join(sizes, "run"), per_key).groupBy("run", "m", "word").agg(F.bit_or("bit").alias("bits"))


def probe(filters: DataFrame, wanted: DataFrame, per_key: int = BITS) -> DataFrame:
    """Those of ``wanted`` (run, key) that the run may hold: all hashes' bits are set."""
    hashes = max(1, round(per_key * log(2)))
    sizes = filters.select("run", "m").distinct()
    asked = _bits(wanted.select("run", "key").distinct().join(sizes, "run"), per_key)
    met = asked.join(filters, ["run", "m", "word"]).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return met.groupBy("run", "key").agg(F.count("*").alias("n")).filter(F.col("n") == hashes).select("run", "key")
