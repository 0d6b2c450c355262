"""Substring dedup as a relative Lempel-Ziv parse against every earlier document.

A window is a run of ``WINDOW`` words. The index files each window of the reference blocks, which are all documents, under its
anchor, the five-word run of least hash inside it, so that equal windows always meet under one key; windows that share an
anchor travel as one row. Under a key, the first document that holds a window is its reference, and windows that
follow one another in document and reference are joined to runs.

A document is then parsed from its start: the next factor begins with the first window not yet covered that has a
reference and goes on as far as that reference goes on in step with the document, and the parse jumps to its end. At that boundary
the windows that begin inside the factor and end behind it are checked: those with a reference of their own begin a
factor that overlaps the one before. Factors, (word_from, word_to, ref_doc, ref_from), are at least a window long; the words
inside them are removed.

Before anything is dealt out, windows that occur in several documents of one group of rows are
settled there, so a passage in a third of all documents arrives as a few rows from each task.

Windows are compared by 64-bit hashes among those of one anchor, itself a 64-bit hash of five words, so that chance
collisions matter only under anchors of many millions of different windows.

Defined cases: null counts as an empty text; rows of equal doc_id are documents of their own (told apart by the CRC-32 of
their texts) that do not refer to each other; a row without doc_id neither loses words nor serves as reference; repeated
rows get equal results; texts of any length are read whole; no rows give no rows; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import checked, shipped, written

WINDOW = 13
ANCHOR = 5
GROUP_BYTES = 4 << 20
#: Up to this many ids of documents with factors are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: at: the mark of the text (its CRC-32, 31 bits) above the word at which the first window begins (32 bits).
ROW = "key long, doc long, at long, windows binary, n int, ref_doc long, ref_start int"
_NAMES = ["key", "doc", "at", "windows", "n", "ref_doc", "ref_start"]


def _rows(key, doc, at, windows, n, ref_doc, ref_start) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip((key, doc, at, windows, n, ref_doc, ref_start), kinds)], _NAMES)


def _blobs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """The values as binary rows; ``first`` has where each row begins."""
    ends = np.append(first, len(values)).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _joined(doc: np.ndarray, start: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of windows begin that lie one after the other in document and reference; their lengths."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (ref_doc[1:] != ref_doc[:-1]) | (ref_start[1:] != ref_start[:-1] + 1)
    first = np.flatnonzero(np.concatenate(([True], new)))
    return first, np.diff(np.append(first, len(doc)))


def _file(batches: Iterator[pa.RecordBatch], secret: wordhash.Key) -> Iterator[pa.RecordBatch]:
    """Rows for the reference lookup (windows set) and factors settled within a group (n set)."""
    width = WINDOW - ANCHOR + 1
    for ids, words, bounds, marks in wordhash.groups(batches, size=GROUP_BYTES, marks=True, key=secret):
        if len(words) < WINDOW:
            continue
        of = np.repeat(np.arange(len(ids)), np.diff(bounds))
        whole = wordhash.runs(words, WINDOW)
        short = wordhash.runs(words, ANCHOR)
        at = np.flatnonzero(of[: len(whole)] == of[WINDOW - 1 :])
        if not len(at):
            continue
        least = np.lib.stride_tricks.sliding_window_view(short, width)[: len(whole)].argmin(axis=1)[at] + at
        gram, doc, start = whole[at], ids[of[at]], (at - bounds[of[at]]).astype(np.int64) | (marks[of[at]] & 0x7FFFFFFF) << 32
        _, first, back = np.unique(gram, return_index=True, return_inverse=True)
        ref = first[back]
        known = doc[ref] < doc
        d, s, rd, rs = doc[known], start[known], doc[ref[known]], start[ref[known]]
        head, n = _joined(d, s, rd, rs)
        if len(head):
            none = pa.nulls(len(head), pa.binary())
            yield _rows((d[head] * 0x9E3779B1) & 0x7FFFFFFF, d[head], s[head], none, n.astype(np.int32), rd[head], (rs[head] & 0xFFFFFFFF).astype(np.int32))
        gram, doc, start, least, at = gram[~known], doc[~known], start[~known], least[~known], at[~known]
        if not len(at):
            continue
        head = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1))))
        empty = pa.nulls(len(head), pa.int32())
        yield _rows(short[least[head]].view(np.int64), doc[head], start[head], _blobs(gram, head), empty, pa.nulls(len(head), pa.int64()), empty)


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (key, doc, at): windows whose first document is another. What is
    carried from batch to batch is the distinct windows of the key that the batch ends in."""
    carried = (None, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for b in batches:
        done = b.filter(pc.is_null(b.column(3)))
        if done.num_rows:
            yield _rows(*done.columns)
        b = b.filter(pc.is_valid(b.column(3)))
        if not b.num_rows:
            continue
        key, doc, start = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
        blobs = b.column(3).to_pylist()
        n = np.array([len(x) // 8 for x in blobs])
        gram = np.frombuffer(b"".join(blobs), np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        doc, start, key_of = doc[row], start[row] + np.arange(len(gram)) - np.repeat(np.cumsum(n) - n, n), key[row]
        held = len(carried[1]) if carried[0] == key[0] else 0
        if held:
            gram, doc, start = (np.concatenate((x, y)) for x, y in zip(carried[1:], (gram, doc, start)))
        _, first, back = np.unique(gram, return_index=True, return_inverse=True)
        ref = first[back]
        dup = doc[ref] < doc
        dup[:held] = False
        d, s, rd, rs = doc[dup], start[dup], doc[ref[dup]], start[ref[dup]]
        head, runs = _joined(d, s, rd, rs)
        if len(head):
            yield _rows(pa.nulls(len(head), pa.int64()), d[head], s[head], pa.nulls(len(head), pa.binary()), runs.astype(np.int32), rd[head], (rs[head] & 0xFFFFFFFF).astype(np.int32))
        last = np.concatenate((np.full(held, key[0]), key_of)) == key[-1]
        keep = np.sort(first[last[first]])
        carried = (key[-1], gram[keep], doc[keep], start[keep])


def referred(docs: DataFrame) -> DataFrame:
    """doc, mark (of its text), start (of the first window), n (windows), ref_doc, ref_start: runs of windows that an earlier
    document holds."""
    filed = docs.select("doc_id", "text").mapInArrow(partial(_file, secret=wordhash.new_key()), ROW)
    met = filed.repartition("key").sortWithinPartitions("key", "doc", "at")
    mark, start = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    return met.mapInArrow(_look_up, ROW).select("doc", mark.alias("mark"), start.alias("start"), "n", "ref_doc", "ref_start")


def parsed(runs: list[dict]) -> list[tuple[int, int, int, int]]:
    """The factors of one document, (word_from, word_to, ref_doc, ref_from), from its runs of windows with references."""
    joined: list[list[int]] = []
    for r in sorted(runs, key=lambda r: (r["start"], -r["n"])):
        start, to = r["start"], r["start"] + r["n"] + WINDOW - 1
        p = joined[-1] if joined else None
        if p and p[2] == r["ref_doc"] and start - p[0] == r["ref_start"] - p[3] and start <= p[1] - WINDOW + 1:  # goes on in step
            p[1] = max(p[1], to)
        else:
            joined.append([start, to, r["ref_doc"], r["ref_start"]])
    out: list[tuple[int, int, int, int]] = []
    for f in joined:
        # inside the factor before: jumped over; across its end: found by the check at the boundary
        if not out or f[1] > out[-1][1]:
            out.append(tuple(f))
    return out


_FACTOR = pa.list_(pa.struct([("word_from", pa.int32()), ("word_to", pa.int32()), ("ref_doc", pa.int64()), ("ref_from", pa.int32())]))


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _FACTOR.value_type]
    for b in batches:
        for i in range(0, b.num_rows, 256):
            piece = b.slice(i, 256)
            total, gone, kept, found = [], [], [], []
            for text, runs in zip(piece.column(1), piece.column(2).to_pylist()):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                stays, parts = np.ones(len(words), bool), parsed(runs or [])
                for lo, hi, *_ in parts:
                    stays[lo:hi] = False
                total.append(len(words))
                gone.append(int(len(words) - stays.sum()))
                kept.append(b" ".join(words[j] for j in np.flatnonzero(stays)) if parts else b" ".join(words))
                found.append([dict(zip(names, p)) for p in parts])
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), text, pa.array(found, _FACTOR)], ["doc_id", "n_words", "n_removed", "kept", "factors"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words, one space apart) and factors."""
    shipped(docs.sparkSession)
    # a set, since repeated rows find the same runs
    by_doc = written(referred(docs).groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "n", "ref_doc", "ref_start")).alias("runs")), "factors")
    texts = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)).alias("of"))
    kind = by_doc.schema["runs"].dataType
    ids = by_doc.select("doc", "mark")
    same = (F.col("doc_id") == F.col("doc")) & (F.col("of") == F.col("mark"))
    if (few := checked(ids, BROADCAST_IDS)) is not ids:  # texts without factors need not be shuffled then
        hit = texts.join(few, same, "left_semi").join(by_doc, same).select("doc_id", "text", "runs")
        rest = texts.join(few, same, "left_anti").select("doc_id", "text", F.lit(None).cast(kind).alias("runs"))
        rows = hit.unionByName(rest)
    else:
        rows = texts.join(by_doc, same, "left").select("doc_id", "text", "runs")
    out = "doc_id long, n_words long, n_removed long, kept string, factors array<struct<word_from:int,word_to:int,ref_doc:long,ref_from:int>>"
    return rows.mapInArrow(_rewrite, out)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w WHERE len(words) >= 13),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram FROM p),
m AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
d AS (SELECT DISTINCT g.doc_id, g.i + k AS i FROM g JOIN m ON g.gram = m.gram AND m.first < g.doc_id, range(13) AS r(k)),
x AS (SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x LEFT JOIN d ON x.doc_id = d.doc_id AND x.i = d.i WHERE d.doc_id IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""
