"""Scans of a view by predicates on keys, in key order, with paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.plans.keys import fuzzy_regex, glob_regex, prefix_end, valid_regex


def matches(kind: str, pattern: str | None, column: str = "key") -> Column:
    """One of the key predicates: all, exact, prefix, suffix, contains, regex, fuzzy, glob."""
    key = F.col(column)
    if kind == "all":
        return F.lit(True)
    if kind == "exact":
        return key == pattern
    if kind == "prefix":
        return key.startswith(pattern)
    if kind == "suffix":
        return key.endswith(pattern)
    if kind == "contains":
        return key.contains(pattern)
    if kind == "regex":  # an invalid pattern matches nothing
        return key.rlike(pattern) if valid_regex(pattern) else F.lit(False)
    if kind == "fuzzy":
        return key.rlike(fuzzy_regex(pattern)) if pattern else F.lit(True)
    if kind == "glob":
        return key.rlike(glob_regex(pattern))
    raise ValueError(f"unknown predicate {kind}")


def key_range(log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with start <= key < end; both bounds are pushed to the files."""
    if start is not None:
        log = log.filter(F.col("key") >= start)
    return log if end is None else log.filter(F.col("key") < end)


def prefix_range(log: DataFrame, prefix: str) -> DataFrame:
    """Rows with the prefix, as a half-open range where an upper bound is text."""
    end = prefix_end(prefix.encode())
    try:
        return key_range(log, prefix, end.decode() if end else None).filter(F.col("key").startswith(prefix))
    except UnicodeDecodeError:
        return log.filter(F.col("key").startswith(prefix))


def page(view: DataFrame, offset: int = 0, limit: int | None = None, order: str = "key") -> DataFrame:
    """Rows in order, some skipped, some taken; a limit of 0 takes none."""
    out = view.orderBy(order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def scan(view: DataFrame, offset: int = 0, limit: int | None = None, **predicates: str) -> DataFrame:
    """Rows that meet every predicate, e.g. ``scan(view, prefix="a", contains="b")``."""
    for kind, pattern in predicates.items():
        view = view.filter(matches(kind, pattern))
    return page(view, offset, limit)


def scan_exact(view: DataFrame, key: str) -> DataFrame:
    """Always one row; its value is null where the key is absent."""
    one = view.sparkSession.range(1).select(F.lit(key).alias("key"))
    return one.join(view.filter(F.col("key") == key).select("key", "value"), "key", "left")
