import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revlake.functions import scalars as fn


def test_checksum_value():
    assert fn.checksum(b"123456789") == 0xE7B8228F


def test_native_sums(spark):
    texts = ["", "a", "click:0001", "é中😀", "x" * 300]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fn.adler32(F.col("t")).alias("a"), fn.fnv1a(F.col("t")).alias("f"), fn.checksum_column(F.col("t")).alias("c")).collect()
    for r in out:
        data, h = r.t.encode(), 2166136261
        for b in data:
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        assert (r.a, r.f, r.c) == (zlib.adler32(data), h, fn.checksum(data))


@settings(max_examples=200)
@given(st.integers(0, 2**53))
def test_varint_round_trip(n):
    assert fn.unvarint(fn.varint(n)) == n


def test_varint_length(spark):
    ns = [0, 1, 127, 128, 16383, 16384, 2**35 - 1, 2**35, 2**53]
    out = spark.createDataFrame([(n,) for n in ns], "n long").select("n", fn.varint_length(F.col("n")).alias("l")).collect()
    assert all(r.l == len(fn.varint(r.n)) for r in out)


def test_only_the_tried_bytes_are_sent_to_python(spark):
    """The rest of a value would fill a worker's batches with texts."""
    noise = random.Random(1).randbytes(3000).hex()
    texts = [None, "", "a" * 128, "a" * 129, "é" * 64, "é" * 65, noise[:127], "".join(map(chr, range(0x4E00, 0x4E00 + 400))), "ab" * 900_000, "中" * 341 + noise]
    found = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", "t", fn.worth_compressing("t").alias("c"))
    head = lambda x: x.encode()[:1024]
    want = [x is not None and len(x.encode()) > 128 and len(zlib.compress(head(x))) <= 0.9 * len(head(x)) for x in texts]
    assert [r.c for r in found.orderBy("i").collect()] == want and True in want and False in want
    assert re.search(r"_deflates\(substring\(cast\(t#\d+ as binary\), 1, 1024\)\)", found._jdf.queryExecution().analyzed().toString())


def test_varint_columns_are_exact_at_any_size(spark):
    ns = [0, 127, 128, 2**42 - 1, 2**42, 2**53 + 1, 2**56 - 1, 2**56, 2**62 + 12345, 2**63 - 1]
    h = fn.varint_hex(F.col("n"))
    out = spark.createDataFrame([(n,) for n in ns], "n long").select("n", h.alias("h"), fn.unvarint_hex(h).alias("back"), fn.varint_length(F.col("n")).alias("l")).collect()
    for r in out:
        assert bytes.fromhex(r.h) == fn.varint(r.n) and r.back == r.n and r.l == len(fn.varint(r.n))
