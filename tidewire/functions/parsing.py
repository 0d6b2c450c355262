"""Tables, records and units inside binary packets, as column expressions over hexadecimal strings, and picture sizes
from parameter sets, which are read bit by bit in small Arrow functions.

Structures of varying length are walked by ``aggregate`` over a sequence that is as long as the structure can be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .wire import hexed


def number(h: Column, at: Column | int, n: int) -> Column:
    """The ``n`` bytes from byte ``at`` on, as a number; null behind the end."""
    part = piece(h, at, F.lit(n))
    return F.when(F.length(part) == 2 * n, F.conv(part, 16, 10).cast("long"))


def piece(h: Column, at: Column | int, n: Column) -> Column:
    return F.substring(h, ((F.lit(at) if isinstance(at, int) else at) * 2 + 1).cast("int"), (n * 2).cast("int"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, by a one-element transform."""
    return F.element_at(F.transform(F.array(value), use), 1)


def size(h: Column) -> Column:
    return F.floor(F.length(h) / 2)


def bits_to_hex(bits: Column) -> Column:
    """A string of bits, filled up with zeros, in hexadecimal."""
    full = F.rpad(bits, F.ceil(F.length(bits) / 8).cast("int") * 8, "0")
    # the function of each byte must not name the string, which would be made again for every byte
    return F.array_join(F.transform(F.regexp_extract_all(full, F.lit("([01]{8})")), lambda b: F.lpad(F.conv(b, 2, 16), 2, "0")), "")


# Transport packets and their tables


def transport_packet(pid: Column, payload: Column, starts: Column, error: Column, sync: Column) -> Column:
    """A packet of 188 bytes in hexadecimal: an adaptation field of stuffing before a payload of up to 182 bytes."""
    second = F.shiftright(pid, 8) + F.when(starts, 0x40).otherwise(0) + F.when(error, 0x80).otherwise(0)
    stuff = F.lit(183) - size(payload)
    head = F.concat(F.when(sync, "47").otherwise("00"), hexed(second, 2), hexed(pid.bitwiseAND(255), 2), F.lit("30"), hexed(stuff.cast("long"), 2), F.lit("00"))
    return F.concat(head, F.repeat(F.lit("FF"), (stuff - 1).cast("int")), payload)


def transport_payload(h: Column) -> Column:
    """What a packet carries behind its header and adaptation field; null if it has no sync byte, is marked as damaged, has
    no payload, or says more than it holds."""
    second, control, field = number(h, 1, 1), F.shiftright(number(h, 3, 1), 4).bitwiseAND(3), number(h, 4, 1)
    good = (number(h, 0, 1) == 0x47) & (second.bitwiseAND(0x80) == 0) & (F.length(h) == 376)
    at = F.when(control == 1, 4).when((control == 3) & (field <= 182), field + 5)
    return F.when(good & at.isNotNull(), piece(h, at, F.lit(188)))


def section(payload: Column) -> Column:
    """The table section behind the pointer field; null if it is cut off."""
    def cut(at: Column) -> Column:
        return bound(number(payload, at + 1, 2).bitwiseAND(0xFFF) + 3, lambda n: F.when(size(payload) >= at + n, piece(payload, at, n)))

    return bound(number(payload, 0, 1) + 1, cut)


def programs(sec: Column) -> Column:
    """(program, pid) of a program association section; null if it is none."""
    n = F.floor((size(sec) - 12) / 4).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(number(sec, i * 4 + 8, 2).alias("program"), number(sec, i * 4 + 10, 2).bitwiseAND(0x1FFF).alias("pid")))
    none = F.array().cast("array<struct<program:bigint,pid:bigint>>")
    return F.when((number(sec, 0, 1) == 0) & (size(sec) >= 8), F.when(n > 0, each).otherwise(none))


def _walked(start: Column, end: Column, most: Column, kind: str, read: Callable[[Column], Column]) -> Column:
    """Elements from byte ``start`` to ``end``: ``read`` gives the element (of type ``kind``, null at damage) at a byte and the
    byte behind it, as a struct of one and after."""
    state = F.struct(start.cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        def grown(r: Column) -> Column:
            more = (s["at"] < end) & r["one"].isNotNull()
            return F.struct(F.when(more, r["after"]).otherwise(end).cast("long").alias("at"), F.when(more, F.concat(s["out"], F.array(r["one"]).cast(f"array<{kind}>"))).otherwise(s["out"]).alias("out"))

        return bound(read(s["at"]), grown)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1)).cast("int")), state, step, lambda s: s["out"])


_STREAM = "struct<kind:bigint,pid:bigint,descriptors:string>"
_DESCRIPTOR = "struct<tag:bigint,body:string>"


def _element(one: Column, after: Column) -> Column:
    return F.struct(one.alias("one"), after.alias("after"))


def streams(sec: Column) -> Column:
    """(kind, pid, descriptors) of a program map section; null if it is none."""
    end = size(sec) - 4

    def read(at: Column) -> Column:
        def found(n: Column) -> Column:
            one = F.struct(number(sec, at, 1).alias("kind"), number(sec, at + 1, 2).bitwiseAND(0x1FFF).alias("pid"), piece(sec, at + 5, n).alias("descriptors"))
            return _element(F.when(at + 5 + n <= end, one), at + 5 + n)

        return bound(number(sec, at + 3, 2).bitwiseAND(0xFFF), found)

    walked = bound(number(sec, 10, 2).bitwiseAND(0xFFF) + 12, lambda start: _walked(start, end, F.floor((end - start) / 5), _STREAM, read))
    return F.when((number(sec, 0, 1) == 2) & (size(sec) >= 12), walked)


def descriptors(h: Column) -> Column:
    """(tag, body) of a run of descriptors."""
    end = size(h)

    def read(at: Column) -> Column:
        return bound(number(h, at + 1, 1), lambda n: _element(F.when(at + 2 + n <= end, F.struct(number(h, at, 1).alias("tag"), piece(h, at + 2, n).alias("body"))), at + 2 + n))

    return _walked(F.lit(0), end, F.floor(end / 2), _DESCRIPTOR, read)


# Stream types that are video and audio; the tag of the descriptor that holds a type's parameter sets.
VIDEO_TYPES, AUDIO_TYPES = (0x01, 0x02, 0x1B, 0x24, 0x51), (0x03, 0x04, 0x0F, 0x11, 0x81)
AVC_TAG, HEVC_TAG, AV1_TAG = 0x28, 0x38, 0x42


def _sized(h: Column, start: Column, count: Column) -> Column:
    """(at, out): ``count`` units of two bytes of size and a body each, and the byte behind them."""
    state = F.struct(start.cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        n = number(h, s["at"], 2)
        fits = (i <= count) & (s["at"] + 2 + n <= size(h))
        return F.struct(F.when(fits, s["at"] + 2 + n).otherwise(s["at"]).cast("long").alias("at"), F.when(fits, F.concat(s["out"], F.array(piece(h, s["at"] + 2, n)))).otherwise(s["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1)).cast("int")), state, step)


def parameter_sets(kind: Column, found: Column) -> Column:
    """Parameter sets in the descriptors of a stream: from an AVC configuration record its sequence and picture sets, from
    an HEVC one the units of its first array, from an AV1 one what follows the four bytes of its head."""
    none = F.array().cast("array<string>")

    def sets(d: Column) -> Column:
        body = d["body"]
        avc = bound(_sized(body, F.lit(6), F.coalesce(number(body, 5, 1).bitwiseAND(31), F.lit(0))), lambda first: F.concat(first["out"], _sized(body, first["at"] + 1, F.coalesce(number(body, first["at"], 1), F.lit(0)))["out"]))
        hevc = _sized(body, F.lit(26), F.coalesce(number(body, 24, 2), F.lit(0)))["out"]
        av1 = F.when(F.length(body) > 8, F.array(F.substring(body, F.lit(9), F.length(body)))).otherwise(none)
        return F.when((d["tag"] == AVC_TAG) & kind.isin(0x1B, 0), avc).when((d["tag"] == HEVC_TAG) & (kind == 0x24), hevc).when((d["tag"] == AV1_TAG) & (kind == 0x51), av1).otherwise(none)

    return F.flatten(F.transform(found, sets))


# Payload formats


def h264_payload(h: Column) -> Column:
    """What a payload holds: error, units (whole ones) and, for a fragment, starts, ends and body (with the unit's header
    where it starts)."""
    head, second = number(h, 0, 1), number(h, 1, 1)
    kind = head.bitwiseAND(31)
    starts, ends = second >= 0x80, second.bitwiseAND(0x40) != 0
    unit = hexed(head.bitwiseAND(0xE0) + second.bitwiseAND(31), 2)
    return _held(
        F.when(head.isNull(), "short").when(head >= 0x80, "forbidden").when(kind.isin(0, 30, 31), "reserved").when(kind.isin(25, 26, 27, 29), "unsupported"),
        (kind >= 1) & (kind <= 23), kind == 24, (kind == 28) & starts & ends, (kind == 28) & (size(h) > 2), h, 1, 2, unit, starts, ends)


def hevc_payload(h: Column) -> Column:
    """The same of an HEVC payload, whose headers have two bytes; packets of type 50 hold nothing, nor do fragments that start and end."""
    head, layer, third = number(h, 0, 1), number(h, 1, 1), number(h, 2, 1)
    kind = F.shiftright(head, 1).bitwiseAND(63)
    starts, ends = third >= 0x80, third.bitwiseAND(0x40) != 0
    unit = F.concat(hexed(head.bitwiseAND(0x81) + third.bitwiseAND(63) * 2, 2), hexed(layer, 2))
    return _held(
        F.when(layer.isNull(), "short").when(head >= 0x80, "forbidden").when(layer.bitwiseAND(7) == 0, "temporal id").when(kind > 50, "unsupported"),
        kind < 48, kind == 48, F.lit(False), (kind == 49) & (size(h) > 3) & ~(starts & ends), h, 2, 3, unit, starts, ends)


def _held(error: Column, single: Column, many: Column, alone: Column, part: Column, h: Column, head: int, body: int, unit: Column, starts: Column, ends: Column) -> Column:
    none = F.array().cast("array<string>")
    end = size(h)

    def read(at: Column) -> Column:
        return bound(number(h, at, 2), lambda n: _element(F.when((n > 0) & (at + 2 + n <= end), piece(h, at + 2, n)), at + 2 + n))

    inside = _walked(F.lit(head), end, F.floor(end / 3), "string", read)
    # an aggregate whose sizes do not fill it to its end is damaged; the units before the damage count
    filled = F.aggregate(inside, F.lit(head).cast("long"), lambda a, u: a + 2 + size(u)) == end
    rest = piece(h, body, end)
    units = F.when(error.isNotNull(), none).when(single, F.array(h)).when(many, inside).when(alone, F.array(F.concat(unit, rest))).otherwise(none)
    is_part = error.isNull() & part & ~alone
    return F.struct(
        F.coalesce(error, F.when(many & ~filled, "truncated")).alias("error"), units.alias("units"), F.coalesce(is_part, F.lit(False)).alias("part"),
        F.coalesce(is_part & starts, F.lit(False)).alias("starts"), F.coalesce(is_part & ends, F.lit(False)).alias("ends"), F.when(is_part, F.concat(F.when(starts, unit).otherwise(""), rest)).alias("body"))


# Picture sizes


class _Bits:
    def __init__(self, data: bytes):
        self.text, self.at = bin(int.from_bytes(b"\1" + data))[3:], 0

    def take(self, n: int) -> int:
        out, self.at = self.text[self.at : self.at + n], self.at + n
        if len(out) < n:
            raise ValueError("too short")
        return int(out, 2) if n else 0

    def ue(self) -> int:
        zeros = self.text.find("1", self.at) - self.at
        if not 0 <= zeros <= 31:
            raise ValueError("no such code")
        self.at += zeros
        return self.take(zeros + 1) - 1

    def se(self) -> int:
        code = self.ue()
        return (code + 1) // 2 if code % 2 else -(code // 2)


# Profiles whose sets name a chroma format; samples of a chroma sample by format (0 to 3).
HIGH = (44, 83, 86, 100, 110, 118, 122, 128, 138, 244)
ACROSS, DOWN = (1, 2, 2, 1), (1, 2, 1, 1)


def h264_size(data: bytes) -> tuple[int, int]:
    """Width and height of a sequence parameter set of H.264, without its header byte."""
    b = _Bits(data)
    profile = b.take(8)
    b.take(16), b.ue()
    chroma = 1
    if profile in HIGH:
        chroma = b.ue()
        if chroma == 3:
            b.take(1)
        b.ue(), b.ue(), b.take(1)
        if b.take(1):
            for i in range(12 if chroma == 3 else 8):
                if b.take(1):
                    last = following = 8
                    for _ in range(16 if i < 6 else 64):
                        if following:
                            following = (last + b.se()) % 256
                        last = following or last
    b.ue()
    order = b.ue()
    if order == 0:
        b.ue()
    elif order == 1:
        b.take(1), b.se(), b.se()
        for _ in range(b.ue()):
            b.se()
    b.ue(), b.take(1)
    across, down, frames = b.ue() + 1, b.ue() + 1, b.take(1)
    if not frames:
        b.take(1)
    b.take(1)
    left, right, top, bottom = (b.ue() for _ in range(4)) if b.take(1) else (0, 0, 0, 0)
    rows = 2 - frames
    return across * 16 - (left + right) * ACROSS[chroma], down * 16 * rows - (top + bottom) * DOWN[chroma] * rows


def hevc_size(data: bytes) -> tuple[int, int]:
    """Width and height of a sequence parameter set of HEVC, without its two header bytes."""
    b = _Bits(data)
    b.take(4)
    layers = b.take(3)
    b.take(1), b.take(88), b.take(8)
    if layers:
        has = [(b.take(1), b.take(1)) for _ in range(8)][:layers]
        for profile, level in has:
            b.take(88 * profile + 8 * level)
    b.ue()
    chroma = b.ue()
    if chroma == 3 and b.take(1):
        chroma = 0
    width, height = b.ue(), b.ue()
    if b.take(1):
        left, right, top, bottom = (b.ue() for _ in range(4))
        across, down = (left + right) * ACROSS[chroma], (top + bottom) * DOWN[chroma]
        if across < width and down < height:
            return width - across, height - down
    return width, height


# Unit types of sequence parameter sets.
H264_SPS, HEVC_SPS = 7, 33


def first_size(units: list[bytes], codec: str) -> tuple[int, int] | None:
    """The size in the first unit that has one."""
    for unit in units:
        clean = unit.replace(b"\x00\x00\x03", b"\x00\x00")
        try:
            if codec == "H264" and unit and unit[0] & 31 == H264_SPS:
                found = h264_size(clean[1:])
            elif codec == "HEVC" and unit and unit[0] >> 1 & 63 == HEVC_SPS:
                found = hevc_size(clean[2:])
            else:
                continue
        except (ValueError, IndexError):
            continue
        if found[0] > 0 and found[1] > 0:
            return found
    return None


_SIZE = pa.struct([("width", pa.int64()), ("height", pa.int64())])


def picture_size(units: Column, codec: Column) -> Column:
    """(width, height) from the first of the units (array<binary>) that has one, else null."""
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for u, c in batches:
            found = [first_size(a or [], b) for a, b in zip(u.to_pylist(), c.to_pylist())]
            yield pa.array([None if x is None else {"width": x[0], "height": x[1]} for x in found], _SIZE)

    return F.arrow_udf(run, "struct<width:bigint,height:bigint>", F.ArrowUDFType.SCALAR_ITER)(units, codec)


# Sizes that need not be multiples of eight.
COMMON = [(1920, 1080), (1280, 720), (3840, 2160), (1920, 1200), (1600, 900), (1366, 768), (1024, 768), (1280, 1024), (1440, 900), (1680, 1050), (2560, 1440), (3440, 1440), (720, 480), (720, 576), (640, 480), (800, 600)]


def plausible(width: Column, height: Column) -> Column:
    known = F.lit([f"{w}x{h}" for w, h in COMMON])
    near = (width % 8 == 0) & (height % 8 == 0) | F.array_contains(known, F.concat_ws("x", width, height))
    return width.between(64, 7680) & height.between(64, 4320) & (width >= 0.25 * height) & (width <= 4.0 * height) & near
