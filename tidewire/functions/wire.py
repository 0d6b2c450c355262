"""Fields of binary packets as column expressions, and the encoders that make such packets.

Bytes at fixed places are read with ``substring`` and ``conv``; fields of varying length with small
pandas functions over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def byte(data: Column, at: int) -> Column:
    """The byte at a place from 0, as a number."""
    return F.conv(F.hex(F.substring(data, at + 1, 1)), 16, 10).cast("long")


def hexed(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


def hexed_whole(value: Column, digits: int) -> Column:
    """At least so many digits (an even number), more where the number has more, always in whole bytes."""
    h = F.hex(value)
    return F.lpad(h, F.greatest(F.lit(digits), F.length(h) + F.length(h) % 2), "0")


def ts_header(pid: Column, counter: Column, starts: Column) -> Column:
    """The four bytes that begin a transport packet with payload only."""
    second = F.shiftright(pid, 8) + F.when(starts, 0x40).otherwise(0)
    return F.unhex(F.concat(F.lit("47"), hexed(second, 2), hexed(pid.bitwiseAND(255), 2), hexed(counter + 0x10, 2)))


def ts_fields(data: Column) -> dict[str, Column]:
    b1, b2, b3 = byte(data, 1), byte(data, 2), byte(data, 3)
    return {
        "sync": byte(data, 0) == 0x47, "error": b1.bitwiseAND(0x80) != 0, "starts": b1.bitwiseAND(0x40) != 0, "pid": b1.bitwiseAND(0x1F) * 256 + b2,
        "control": F.shiftright(b3, 4).bitwiseAND(3), "counter": b3.bitwiseAND(15),
    }


def timestamp_bytes(ts: Column, prefix: int) -> Column:
    """A 33-bit time in five bytes, with its prefix and marker bits."""
    b0 = F.lit(prefix * 16 + 1) + F.shiftright(ts, 30).bitwiseAND(7) * 2
    b12 = F.shiftright(ts, 15).bitwiseAND(0x7FFF) * 2 + 1
    b34 = ts.bitwiseAND(0x7FFF) * 2 + 1
    return F.unhex(F.concat(hexed(b0, 2), hexed(b12, 4), hexed(b34, 4)))


def timestamp(data: Column, at: int = 0) -> Column:
    """A 33-bit time; null if a marker bit is missing."""
    b = [byte(data, at + i) for i in range(5)]
    marks = (b[0].bitwiseAND(1) == 1) & (b[2].bitwiseAND(1) == 1) & (b[4].bitwiseAND(1) == 1)
    value = F.shiftright(b[0], 1).bitwiseAND(7) * (1 << 30) + F.shiftright(b[1] * 256 + b[2], 1) * (1 << 15) + F.shiftright(b[3] * 256 + b[4], 1)
    return F.when(marks, value)


def leb128(value: Column, most: int = 10) -> Column:
    """A number in groups of seven bits, the least first, with a flag on all but the last."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(value / F.pow(F.lit(128.0), i)).cast("long") % 128)
    n = leb128_size(value)
    return F.unhex(F.array_join(F.transform(F.slice(groups, 1, n), lambda g, i: F.lpad(F.hex(g + F.when(i < n - 1, 128).otherwise(0)), 2, "0")), ""))


def leb128_size(value: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("int")


def leb128_value(data: Column) -> Column:
    """The number that the bytes hold, up to 63 bits."""
    each = F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long").bitwiseAND(127))
    return F.aggregate(F.reverse(each), F.lit(0).cast("long"), lambda a, g: a * 128 + g)


def exp_golomb_bits(value: Column) -> Column:
    """ue(v): as many zeros as the number plus one has bits after its first, then these bits."""
    bits = F.bin(value + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(bits) - 1), bits)


def exp_golomb(bits: Column) -> Column:
    """ue(v) at the start of a string of bits; null beyond 31 zeros."""
    zeros = F.locate("1", bits) - 1
    return F.when((zeros >= 0) & (zeros <= 31), F.conv(F.substring(bits, zeros + 1, zeros + 1), 2, 10).cast("long") - 1)


def signed_golomb(ue: Column) -> Column:
    """se(v) from ue(v): 0, 1, -1, 2, -2 ..."""
    return F.when(ue % 2 == 1, 1).otherwise(-1) * F.ceil(ue / 2)


@pandas_udf(T.BinaryType())
def escaped(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A payload in which no start code can occur: 3 after two zeros before 0 to 3."""
    import re

    pattern = re.compile(rb"\x00\x00(?=[\x00-\x03])")
    for s in payloads:
        yield s.map(lambda d: pattern.sub(b"\x00\x00\x03", d), na_action="ignore")


@pandas_udf(T.BinaryType())
def unescaped(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The payload without the bytes that ``escaped`` put in."""
    import re

    pattern = re.compile(rb"\x00\x00\x03(?=[\x00-\x03]|\Z)", re.S)
    for s in payloads:
        yield s.map(lambda d: pattern.sub(b"\x00\x00", d), na_action="ignore")


@pandas_udf(T.ArrayType(T.BinaryType()))
def nal_units(streams: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The units between start codes of three or four bytes."""
    import re

    code = re.compile(rb"\x00?\x00\x00\x01")
    for s in streams:
        yield s.map(lambda d: [u for u in code.split(d)[1:] if u], na_action="ignore")
