"""What packets and frames of several codecs are made of, read from their bytes in small Arrow functions: elements of
AV1 payloads, the kinds of units in a packet, and the first fields of H.264 slices and parameter sets.

Each function reads one value and knows nothing of the values around it; what carries over from packet to packet is left to
windows (``operators.payloads``, ``operators.boundaries``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import _Bits, number, piece, size

_CODE = re.compile(rb"\x00?\x00\x00\x01")
_ESCAPE = re.compile(rb"\x00\x00\x03(?=[\x00-\x03]|\Z)", re.S)

#: Bytes of one unit and of one frame, units of a packet (of AV1: fewer) at most.
UNIT_BYTES, FRAME_BYTES, MOST_UNITS, MOST_OBUS = 10 << 20, 50 << 20, 1000, 500


def _each(made: Callable, kind: pa.DataType, spark_kind: str, *columns: Column) -> Column:
    """``made`` of each row's values (null where the first is null), as an Arrow function."""
    def run(batches: Iterator) -> Iterator[pa.Array]:
        for b in batches:
            values = [x.to_pylist() for x in (b if isinstance(b, tuple) else (b,))]
            yield pa.array([None if v[0] is None else made(*v) for v in zip(*values)], kind)

    return F.arrow_udf(run, spark_kind, F.ArrowUDFType.SCALAR_ITER)(*columns)


def leb128_at(data: bytes, at: int) -> tuple[int, int] | None:
    """A number in groups of seven bits, and the byte behind it; None if it does not end within ten bytes or 64 bits."""
    value = 0
    for i in range(at, min(len(data), at + 10)):
        value |= (data[i] & 127) << 7 * (i - at)
        if data[i] < 128:
            return (value, i + 1) if value < 1 << 64 else None
    return None


# AV1


def av1_elements(payload: bytes) -> list[bytes] | None:
    """The elements of an AV1 payload with its aggregation header; None if their sizes do not fit. Without a count each has its size,
    and empty ones are left out; with a count the last one has none and takes what is left."""
    count, at, out = payload[0] >> 4 & 3, 1, []
    while at < len(payload) and (not count or len(out) < count - 1):
        told = leb128_at(payload, at)
        if told is None or told[0] > len(payload) - told[1]:
            return None
        n, at = told
        if n or count:
            out.append(payload[at : at + n])
        at += n
    return [*out, payload[at:]] if at < len(payload) else out


def av1_payload(data: Column) -> Column:
    """What an AV1 payload (binary) holds: continues (its first element goes on from the packet before), goes_on (its last one goes on
    in the next), new (a temporal unit begins), damaged, units (whole ones) and body (the part of a unit). Null for no bytes."""
    def made(payload: bytes) -> dict | None:
        if not payload:
            return None
        z, y = payload[0] >= 128, payload[0] & 64 != 0
        units = None if z or y else av1_elements(payload)
        return {"continues": z, "goes_on": y, "new": payload[0] & 8 != 0, "damaged": not (z or y) and units is None, "units": units or [], "body": payload[1:] if z or y else None}

    kind = pa.struct([("continues", pa.bool_()), ("goes_on", pa.bool_()), ("new", pa.bool_()), ("damaged", pa.bool_()), ("units", pa.list_(pa.binary())), ("body", pa.binary())])
    return _each(made, kind, "struct<continues:boolean,goes_on:boolean,new:boolean,damaged:boolean,units:array<binary>,body:binary>", data)


def obu_kind(unit: Column) -> Column:
    """The type of an AV1 unit; null for an empty one or one with the forbidden bit."""
    head = number(F.hex(unit), 0, 1)
    return F.when(head < 128, F.shiftright(head, 3).bitwiseAND(15)).cast("int")


def obus(data: bytes) -> list[tuple[int, int | None]] | None:
    """(type, first byte) of the units of a packet; None if one has the forbidden bit, a wrong size, or if they are too many.
    What does not fit at the end is left out, and so is all behind padding."""
    out: list[tuple[int, int | None]] = []
    at = 0
    while at < len(data):
        head, at = data[at], at + 1
        if head & 0x80:
            return None
        at += head >> 2 & 1
        n = len(data) - at
        if head & 2:
            if at >= len(data):
                break
            if (told := leb128_at(data, at)) is None:
                return None
            n, at = told
        if n > UNIT_BYTES:
            return None
        if n < 0 or at + n > len(data):
            break
        out.append((head >> 3 & 15, data[at] if n else None))
        at += n
        if len(out) >= MOST_OBUS:
            return None
        if out[-1][0] == 15:
            break
    return out


# JPEG XS


def markers(data: bytes) -> list[int]:
    """The second bytes of the markers of a packet; the segments of all but the first two kinds are stepped over."""
    out, at = [], 0
    while at < len(data) - 1:
        if data[at] == 0xFF and 0x10 <= data[at + 1] <= 0x1F:
            out.append(data[at + 1])
            sized = at + 3 < len(data) and data[at + 1] not in (0x10, 0x11)
            at += int.from_bytes(data[at + 2 : at + 4]) + 1 if sized else 1
        at += 1
    return out


def xs_payload(h: Column) -> Column:
    """The header of a JPEG XS payload in hexadecimal: first, last, frame (24 bits), profile (null without an extended header) and
    body; null if it is too short."""
    flags = number(h, 0, 1)
    more = flags.bitwiseAND(4) != 0
    head = F.when(more, 8).otherwise(4)
    made = F.struct((flags >= 128).alias("first"), (flags.bitwiseAND(64) != 0).alias("last"), number(h, 1, 3).alias("frame"), F.when(more, number(h, 6, 1)).alias("profile"), piece(h, head, size(h)).alias("body"))
    return F.when(size(h) >= head, made)


# Units of a packet


def annex_b(data: bytes) -> list[bytes] | None:
    """The units between start codes; None if one is too large or they are too many."""
    out = [u for u in _CODE.split(data)[1:] if u]
    return None if len(out) >= MOST_UNITS or any(len(u) > UNIT_BYTES for u in out) else out


def _unit_kinds(data: bytes, codec: str) -> list[tuple[int, int | None]] | None:
    if codec == "AV1":
        return obus(data)
    if codec == "JPEGXS":
        return [(m, None) for m in markers(data)]
    if not data.startswith((b"\0\0\1", b"\0\0\0\1")) or (units := annex_b(data)) is None:
        return None
    if codec == "HEVC":
        return [(u[0] >> 1 & 63, u[1]) for u in units if len(u) > 1]
    return [(u[0] & 31, u[1] if len(u) > 1 else None) for u in units]


def unit_kinds(data: Column, codec: Column) -> Column:
    """(kind, head) of the units of a packet (binary): of H.264 and HEVC those behind start codes, of AV1 its OBUs, of JPEG XS
    its markers; head is the byte behind the header. Null if there are no start codes or the units are damaged."""
    def made(d: bytes, c: str) -> list[dict] | None:
        found = _unit_kinds(d, c)
        return None if found is None else [{"kind": k, "head": h} for k, h in found]

    return _each(made, pa.list_(pa.struct([("kind", pa.int32()), ("head", pa.int32())])), "array<struct<kind:int,head:int>>", data, codec)


# H.264 slices and parameter sets

#: Bytes within which the first fields of a unit lie: three codes of at most 63 bits behind 24 bits.
_FIRST = 48


def unit_fields(unit: bytes) -> dict:
    """kind, slice_type, pps and sps of an H.264 unit, as far as its kind has them, and what is wrong with it."""
    kind = unit[0] & 31 if unit else None
    out = {"kind": kind, "slice_type": None, "pps": None, "sps": None, "problem": None if unit else "empty"}
    bits = _Bits(_ESCAPE.sub(b"\0\0", unit[1:_FIRST]))
    at = "length"
    try:
        if kind is not None and 1 <= kind <= 5:
            if len(unit) < 2:
                raise ValueError
            at = "first macroblock"
            bits.ue()
            at = "slice type"
            out["slice_type"] = bits.ue()
            if out["slice_type"] > 9:
                raise ValueError
            at = "pps"
            out["pps"] = bits.ue()
            if out["pps"] > 255:
                raise ValueError
        elif kind == 7:
            bits.take(24)
            at = "sps"
            out["sps"] = bits.ue()
            if out["sps"] > 31:
                raise ValueError
        elif kind == 8:
            at = "pps"
            out["pps"] = bits.ue()
            if out["pps"] > 255:
                raise ValueError
            at = "sps"
            out["sps"] = bits.ue()
            if out["sps"] > 31:
                raise ValueError
    except ValueError:
        out["problem"] = at
    return out


def h264_fields(units: Column) -> Column:
    """(kind, slice_type, pps, sps, problem) of each of a frame's units (array<binary>)."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("slice_type", pa.int32()), ("pps", pa.int64()), ("sps", pa.int64()), ("problem", pa.string())]))
    return _each(lambda units: [unit_fields(u or b"") for u in units], kind, "array<struct<kind:int,slice_type:int,pps:bigint,sps:bigint,problem:string>>", units)


# Checksums

#: Fixed value: the polynomial of CRC-32, lowest power first.
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo the checksum's (the highest bit is the power 0)."""
    out = 0
    while a:
        if a & 1 << 31:
            out ^= b
        a, b = a << 1 & 0xFFFFFFFF, b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def combined_crc(parts: list[dict]) -> int:
    """The CRC-32 of bytes from those of their chunks (crc and size, in order): each is moved on by the bytes behind it."""
    out = 0
    for part in parts:
        # x to the power of 8 * size, by squares
        shift, power, n = 1 << 31, 1 << 30, 8 * part["size"]
        while n:
            if n & 1:
                shift = _times(shift, power)
            power, n = _times(power, power), n >> 1
        out = _times(shift, out) ^ part["crc"]
    return out


def chunked_crc(parts: Column) -> Column:
    """``combined_crc`` of an array of (crc, size)."""
    return _each(combined_crc, pa.int64(), "bigint", parts)


def unit_problem(unit: Column) -> Column:
    """What is wrong with a unit (binary) of H.264 or HEVC: empty, too large, or the forbidden bit; else null."""
    return F.when(F.coalesce(F.length(unit), F.lit(0)) == 0, "empty").when(F.length(unit) > UNIT_BYTES, "size").when(number(F.hex(F.substring(unit, 1, 1)), 0, 1) >= 128, "forbidden")


def frame_problem(units: Column) -> Column:
    """What is wrong with a frame of units: empty, more than a thousand of them, too large as a whole, or one that is wrong."""
    total = F.aggregate(units, F.lit(0).cast("long"), lambda a, u: a + F.coalesce(F.length(u), F.lit(0)))
    found = F.filter(F.transform(units, unit_problem), lambda p: p.isNotNull())
    return F.when(F.coalesce(F.size(units), F.lit(0)) < 1, "empty").when(F.size(units) > MOST_UNITS, "units").when(total > FRAME_BYTES, "size").otherwise(F.get(found, F.lit(0)))
