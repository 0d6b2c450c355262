"""64-bit hashes of words and of runs of words, for many texts at once, with numpy.

A word is read in chunks of eight bytes, each mixed into the hash of what came before it (its length comes after the first one);
words of more than ``LONG`` bytes go through blake2b. A run's hash mixes its words' hashes in one after the other. The mixing
can be inverted, so hashes start from a secret key that each job draws anew (``new_key``): which words meet is then not known to
those who write the texts, and chance meetings are as rare as 64 bits allow.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in groups of about this many bytes, and long ones in pieces of it.
PIECE = 1 << 20
#: Bytes of the longest word that is hashed by chunks.
LONG = 128

#: The two numbers of a key; the key of those who need none.
Key = tuple[int, int]
OPEN: Key = (0, 1)

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def new_key() -> Key:
    """A key for one job: drawn on the driver, the same in all its tasks and in their reruns."""
    return int.from_bytes(os.urandom(8), "little"), int.from_bytes(os.urandom(8), "little") | 1


def words(data: bytes, key: Key = OPEN) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ``data``."""
    gap = _space[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True]))))
    lo, n = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place on
    h = mix(mix((eight[lo] & _MASK[np.minimum(n, 8)]) ^ np.uint64(key[0])) + n.astype(np.uint64) * np.uint64(key[1]))
    at, done = np.flatnonzero(n > 8), 8
    while len(at) and done < LONG:
        h[at] = mix((h[at] + _STEP) * np.uint64(0xD6E8FEB86659FD93) ^ (eight[lo[at] + done] & _MASK[np.minimum(n[at] - done, 8)]))
        done += 8
        at = at[n[at] > done]
    secret = b"".join(k.to_bytes(8, "little") for k in key)
    for i in at:  # few
        h[i] = int.from_bytes(hashlib.blake2b(data[lo[i] : lo[i] + n[i]], digest_size=8, key=secret).digest(), "little")
    return h, lo


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = max(0, len(hashes) - width + 1)
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = (h ^ hashes[j : j + n]) * _STEP
        h ^= h >> np.uint64(29)
    return mix(h)


def _long(data: bytes, key: Key = OPEN) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):  # cut at a gap; a word longer than a piece is kept whole
            while end < len(data) and not _space[data[end]]:
                end += 1
        out.append(words(data[at:end], key)[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def groups(batches: Iterator[pa.RecordBatch], lower: bool = False, size: int = PIECE, marks: bool = False, key: Key = OPEN) -> Iterator[tuple]:
    """From batches of (doc_id, text): groups of documents as (ids, words, bounds); the words of
    the i-th document are words[bounds[i]:bounds[i + 1]]. Null doc_ids are left out; null texts
    have no words. ids rise within a group. With ``marks``, also the CRC-32 of each text."""
    def made(rows: list[tuple[int, bytes]]) -> tuple:
        rows.sort(key=lambda r: r[0])
        ids = np.array([r[0] for r in rows], np.int64)
        more = (np.array([zlib.crc32(r[1]) for r in rows], np.int64),) if marks else ()
        if len(rows) == 1:
            h = _long(rows[0][1], key)
            return ids, h, np.array([0, len(h)]), *more
        h, lo = words(b"\n".join(r[1] for r in rows), key)
        starts = np.cumsum([0, *[len(r[1]) + 1 for r in rows]])
        return ids, h, np.searchsorted(lo, starts), *more

    rows, held = [], 0
    for b in batches:
        for doc, text in zip(b.column(0), b.column(1)):
            if not doc.is_valid:
                continue
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            data = data.lower() if lower else data
            if len(data) >= size:
                yield made([(doc.as_py(), data)])
                continue
            rows.append((doc.as_py(), data))
            held += len(data) + 1
            if held >= size:
                yield made(rows)
                rows, held = [], 0
    if rows:
        yield made(rows)
