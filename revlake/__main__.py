"""A shell over a store: ``python -m revlake STORE COMMAND ...``; ``--json`` prints a line of JSON for each row."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revlake.operators import index, scan, views
from revlake.sources.store import Store

LOG = "key string, rev bigint, value string, created_at_ms bigint"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="revlake")
    p.add_argument("store")
    p.add_argument("--json", action="store_true")
    commands = p.add_subparsers(dest="command", required=True)
    for name, help in (("put", "write a value"), ("get", "the live value of a key"), ("delete", "delete a key"), ("history", "all versions of a key")):
        c = commands.add_parser(name, help=help)
        c.add_argument("key")
        if name == "put":
            c.add_argument("value")
    c = commands.add_parser("scan", help="live keys that meet predicates")
    for kind in ("prefix", "suffix", "contains", "regex", "fuzzy", "glob"):
        c.add_argument(f"--{kind}")
    c.add_argument("--offset", type=int, default=0)
    c.add_argument("--limit", type=int)
    c = commands.add_parser("complete", help="the best completions of what is typed")
    c.add_argument("typed")
    for name, help in (("runs", "the manifest"), ("compact", "compact levels above their targets"), ("vacuum", "delete what is named no more"), ("verify", "damaged runs")):
        commands.add_parser(name, help=help)
    return p


def run(spark: SparkSession, arguments: list[str]) -> DataFrame | dict:
    a = parser().parse_args(arguments)
    store = Store(spark, a.store, StructType.fromDDL(LOG))
    if a.command in ("put", "delete"):
        rev = store.max_rev() + 1
        value = F.lit(a.value if a.command == "put" else None).cast("string")
        store.flush(spark.range(1).select(F.lit(a.key).alias("key"), F.lit(rev).cast("long").alias("rev"), value.alias("value"), F.unix_millis(F.current_timestamp()).alias("created_at_ms")))
        return {"key": a.key, "rev": rev}
    if a.command == "get":
        return store.get(a.key)
    if a.command == "history":
        return views.history(store.read(a.key, a.key + "\0")).orderBy("version")
    if a.command == "scan":
        predicates = {k: v for k in ("prefix", "suffix", "contains", "regex", "fuzzy", "glob") if (v := getattr(a, k)) is not None}
        return scan.scan(views.latest(store.read()), a.offset, a.limit, **predicates)
    if a.command == "complete":
        return index.complete(store.read().select("key").distinct(), a.typed)
    if a.command == "runs":
        return store.manifest()
    if a.command == "compact":
        return store.compact_levels()
    if a.command == "vacuum":
        return {"deleted": store.vacuum()}
    return {"damaged": [r["file"] for r in store.damaged()]}


def main(arguments: list[str]) -> None:
    spark = SparkSession.builder.getOrCreate()
    out = run(spark, arguments)
    if isinstance(out, dict):
        print(json.dumps(out))
    elif "--json" in arguments:
        for line in out.toJSON().toLocalIterator():
            print(line)
    else:
        out.show(1000, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
