"""Order-preserving encodings to binary keys, in built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_long(c: Column) -> Column:
    """Eight bytes, big-endian, sign bit flipped: sorts as the number does."""
    return F.unhex(F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def decode_long(c: Column) -> Column:
    """The reverse: the upper and lower halves of the hex digits, put together, sign bit flipped back."""
    h = F.hex(c)
    half = lambda s: F.conv(s, 16, 10).cast("long")
    return F.shiftleft(half(F.substring(h, 1, 8)), 32).bitwiseOR(half(F.substring(h, 9, 8))).bitwiseXOR(F.lit(-(1 << 63)))


def encode_text(c: Column) -> Column:
    """UTF-8 with each 00 followed by FF, and 00 at the end: a shorter text sorts before its extensions, also
    inside a composite key."""
    pairs = F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "$1 ")
    return F.unhex(F.concat(F.replace(F.regexp_replace(pairs, "00 ", "00FF "), F.lit(" "), F.lit("")), F.lit("00")))


def composite(*parts: Column) -> Column:
    return F.concat(*parts)


def table_key(table_id: int, *parts: Column) -> Column:
    """A key under a table's prefix."""
    return F.concat(F.lit(table_id.to_bytes(4, "big")), *parts)


def key_size(field: Column) -> Column:
    """Length of the key from its packed field."""
    return field.cast("long").bitwiseAND(0x7FFFFFFF)


def is_tombstone(field: Column) -> Column:
    return F.shiftright(field.cast("long"), 31).bitwiseAND(1) == 1


def pack_key_size(size: Column, tombstone: Column) -> Column:
    return size.cast("long").bitwiseOR(F.when(tombstone, F.lit(1 << 31)).otherwise(F.lit(0)))


def load_key(i: Column) -> Column:
    return F.format_string("key-%012d", i)


def xorshift(x: Column) -> Column:
    """One step of the generator with shifts 13, 7, 17."""
    steps = [lambda v: v.bitwiseXOR(F.shiftleft(v, 13)), lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 7)), lambda v: v.bitwiseXOR(F.shiftleft(v, 17))]
    return reduce(lambda v, f: f(v), steps, x.cast("long"))


def text(c: Column) -> Column:
    """For display: bytes that are no UTF-8 are replaced."""
    return F.decode(c, "UTF-8")


def le_uint(c: Column, at: int, size: int) -> Column:
    """An unsigned little-endian integer of a binary value, from byte `at` (0-based); size up to 7."""
    byte = lambda k: F.conv(F.hex(F.substring(c, at + k + 1, 1)), 16, 10).cast("long")
    return reduce(lambda a, b: a + b, [F.shiftleft(byte(k), 8 * k) for k in range(size)])
