"""Byte and checksum functions. Native where Spark has the pieces, else Arrow UDFs."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlake.operators.compact import varint_length  # noqa: F401  (part of this surface)


def byte_values(c: Column) -> Column:
    """The bytes of a string as integers."""
    h = F.hex(F.encode(c, "UTF-8"))
    n = F.octet_length(c)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substring(h, i * 2 - 1, F.lit(2)), 16, 10).cast("long")))


def adler32(c: Column) -> Column:
    zero = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(s, x):
        a = (s["a"] + x) % 65521
        return F.struct(a.alias("a"), ((s["b"] + a) % 65521).alias("b"))

    return F.aggregate(byte_values(c), zero, step, lambda s: s["b"] * 65536 + s["a"])


def fnv1a(c: Column) -> Column:
    return F.aggregate(byte_values(c), F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


#: Fixed value of the checksum variant: the polynomial, not reflected, in a reflected loop.
POLYNOMIAL = 0x1EDC6F41


def _crc_table() -> list[int]:
    table = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ POLYNOMIAL if b & 1 else b >> 1
        table.append(b)
    return table


_CRC = _crc_table()


def checksum(data: bytes) -> int:
    """The store's checksum; its value for b"123456789" is 0xE7B8228F."""
    c = 0
    for b in data:
        c = _CRC[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def checksum_column(c: Column) -> Column:
    """``checksum`` of a string's bytes, by a table of constants."""
    table = F.array(*[F.lit(x).cast("long") for x in _CRC])
    step = lambda h, x: F.element_at(table, (h.bitwiseXOR(x).bitwiseAND(F.lit(255).cast("long")) + 1).cast("int")).bitwiseXOR(F.shiftright(h, 8))
    return F.when(c.isNotNull(), F.aggregate(byte_values(c), F.lit(0).cast("long"), step, lambda h: h.bitwiseXOR(F.lit(0xFFFFFFFF).cast("long"))))


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def unvarint(data: bytes) -> int:
    return sum((b & 127) << 7 * i for i, b in enumerate(data))


def varint_hex(x: Column) -> Column:
    """An unsigned varint as hex digits: seven bits a byte, lowest first, the top bit while more follow."""
    n = varint_length(x).cast("int")
    digits = F.transform(F.sequence(F.lit(1), n), lambda i: F.lpad(F.hex(F.call_function("shiftright", x.cast("long"), (i - 1) * 7).bitwiseAND(F.lit(127).cast("long")) + F.when(i < n, 128).otherwise(0)), 2, "0"))
    return F.lower(F.array_join(digits, ""))


def unvarint_hex(h: Column) -> Column:
    """The number of an unsigned varint in hex digits."""
    digits = F.transform(F.sequence(F.lit(0), (F.length(h) / 2 - 1).cast("int")), lambda i: F.struct(i.alias("i"), F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long").alias("b")))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda s, d: s + F.call_function("shiftleft", d["b"].bitwiseAND(F.lit(127).cast("long")), d["i"] * 7))


def u64_little_endian_hex(x: Column) -> Column:
    """Eight bytes, lowest first, as hex digits."""
    h = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.lower(F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]))


def msgpack_text_hex(c: Column) -> Column:
    """A string in MessagePack, as hex digits; null is nil."""
    n, data = F.octet_length(c), F.hex(F.encode(c, "UTF-8"))
    wide = lambda k: F.lpad(F.hex(n), k, "0")
    head = F.when(n < 32, F.hex(n + 0xA0)).when(n < 256, F.concat(F.lit("D9"), wide(2))).when(n < 65536, F.concat(F.lit("DA"), wide(4))).otherwise(F.concat(F.lit("DB"), wide(8)))
    return F.lower(F.when(c.isNull(), F.lit("C0")).otherwise(F.concat(head, data)))


def msgpack_long_hex(x: Column) -> Column:
    """A whole number from 0 on in MessagePack, as hex digits; null is nil."""
    wide = lambda k: F.lpad(F.hex(x.cast("long")), k, "0")
    sized = F.when(x < 128, wide(2)).when(x < 256, F.concat(F.lit("CC"), wide(2))).when(x < 65536, F.concat(F.lit("CD"), wide(4))).when(x < 2**32, F.concat(F.lit("CE"), wide(8))).otherwise(F.concat(F.lit("CF"), wide(16)))
    return F.lower(F.when(x.isNull(), F.lit("C0")).otherwise(sized))


def msgpack_map_hex(**fields: Column) -> Column:
    """A map of fewer than 16 encoded fields, in the order given."""
    return F.concat(F.lit(f"8{len(fields):x}"), *[x for name, c in fields.items() for x in (msgpack_text_hex(F.lit(name)), c)])


#: Bytes of a value that are tried.
TRIED = 1024


@F.pandas_udf(T.BooleanType())
def _deflates(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x is not None and len(zlib.compress(x)) <= 0.9 * len(x))


def worth_compressing(c: Column | str) -> Column:
    """Values above 128 bytes whose first KiB deflates to 0.9 or less. Only these bytes go to Python,
    so a worker's memory does not depend on the values' length."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.octet_length(c) > 128, F.lit(False)) & _deflates(F.substring(c.cast("binary"), 1, TRIED))


def upper_bound(keys: Column, key: Column) -> Column:
    """How many of the keys are not above ``key``."""
    return F.size(F.filter(keys, lambda k: k <= key)).cast("long")
