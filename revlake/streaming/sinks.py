"""Where deliveries go: memory, files, HTTP or a caller's own function, by name.

Delivery is at least once; every sink knows a delivery by (id, rev) and a file sink
writes a micro-batch to a folder of its own, so a batch that runs again replaces itself.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame

from revlake.plans.keys import backoff_ms

Sink = Callable[[DataFrame, int], None]


class Memory:
    """Deliveries on the driver, once each; for tests and small subscriptions."""

    def __init__(self, most: int = 100_000):
        self.rows: dict[tuple[int, int], tuple] = {}
        self.most = most

    def __call__(self, rows: DataFrame, number: int) -> None:
        for r in rows.select("id", "rev", "key", "value").limit(self.most).toLocalIterator():
            self.rows[r["id"], r["rev"]] = (r["key"], r["value"])


class Files:
    """JSON lines, a folder for each micro-batch and subscription."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def __call__(self, rows: DataFrame, number: int) -> None:
        rows.select("id", "rev", "key", "value").dropDuplicates(["id", "rev"]).write.mode("overwrite").partitionBy("id").json(f"{self.path}/batch={number}")


class Http:
    """POST of JSON arrays from the executors, tried again after growing waits."""

    def __init__(self, url: str, batch: int = 500, attempts: int = 5, headers: dict[str, str] | None = None, timeout: float = 10.0):
        self.url, self.batch, self.attempts, self.headers, self.timeout = url, batch, attempts, headers or {}, timeout

    def send(self, rows: list[dict]) -> None:
        request = urllib.request.Request(self.url, json.dumps(rows).encode(), {"Content-Type": "application/json", **self.headers}, method="POST")
        for attempt in range(self.attempts):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    answer.read()
                return
            except OSError:
                if attempt == self.attempts - 1:
                    raise
                time.sleep(backoff_ms(100, attempt) / 1000)

    def __call__(self, rows: DataFrame, number: int) -> None:
        def post(part) -> None:
            held: list[dict] = []
            for r in part:
                held.append({"id": r["id"], "rev": r["rev"], "key": r["key"], "value": r["value"], "batch": number})
                if len(held) >= self.batch:
                    self.send(held)
                    held = []
            if held:
                self.send(held)

        rows.select("id", "rev", "key", "value").foreachPartition(post)


KINDS: dict[str, Callable[..., Sink]] = {"memory": Memory, "file": Files, "http": Http}


def sink(kind: str | Sink, **options) -> Sink:
    """A sink by name, or the caller's own function as it is."""
    return kind if callable(kind) else KINDS[kind](**options)


class Registry:
    """Handlers of subscriptions by id; those of restored subscriptions are attached again."""

    def __init__(self):
        self.handlers: dict[int, Sink] = {}

    def attach(self, handlers: dict[int, Sink]) -> Registry:
        self.handlers.update(handlers)
        return self

    def detach(self, id: int) -> None:
        self.handlers.pop(id, None)

    def __call__(self, rows: DataFrame, number: int) -> None:
        """Give every subscription's deliveries to its handler; those without one are passed over."""
        for id, handler in list(self.handlers.items()):
            handler(rows.filter(rows["id"] == id), number)


def save(subs: DataFrame, path: str) -> None:
    """Keep a subscription table as JSON lines."""
    subs.select("id", "type", "pattern", "once", "last_seen_rev").coalesce(1).write.mode("overwrite").json(path)


def load(spark, path: str) -> DataFrame:
    """What ``save`` kept; lines that cannot be read are left out."""
    from revlake.operators.watch import restore

    kind = "id long, type string, pattern string, once boolean, last_seen_rev long"
    return restore(spark, spark.read.schema(kind).option("mode", "DROPMALFORMED").json(path))
