"""Numpy kernels over Arrow text buffers, and the Arrow batch plumbing that the operators share.

A kernel sees a block of rows as one byte buffer and row offsets, so that its cost is a few passes over the bytes and
does not depend on how the bytes fall into rows. Null texts are empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a block aims at; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_POWERS = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> np.ndarray:
    """At least n powers of a fixed odd multiplier, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 4096), 0x9E3779B97F4A7C15, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets into them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches of about `limit` bytes of text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            done = ends[at - 1] if at else 0
            stop = min(n, max(at + 1, int(np.searchsorted(ends, done + limit, side="right"))), at + 20000)
            yield batch.slice(at, stop - at)
            at = stop
        batch = sizes = ends = None
    release()


def release() -> None:
    """Gives freed memory back to the system: worker processes live on between tasks, beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@dataclass
class Words:
    """Words of a block: byte spans, the row of each, and for each row the index of its first word (one more entry)."""

    data: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a row end: starts, ends, first run of each row."""
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    real = offs[:-1][np.diff(offs) > 0]
    stop = offs[1:][np.diff(offs) > 0]
    before[real], after[stop - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def words(data: np.ndarray, offs: np.ndarray) -> Words:
    """Runs of bytes other than 0x20 and 0x09-0x0D."""
    starts, ends, first = spans(~WHITE[data], offs)
    return Words(data, offs, starts, ends, first)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte run; runs are disjoint, ascending and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    begin = np.cumsum(lens) - lens
    within = np.arange(begin[-1] + lens[-1]) - np.repeat(begin, lens)
    values = data[within + np.repeat(starts, lens)].astype(np.uint64) + _U(1)
    values *= powers(int(lens.max()))[within]
    return mix64(np.add.reduceat(values, begin) + mix64(lens.astype(np.uint64) + _U(seed * 0x51ED2701)))


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` successive words inside a row: (hashes, index of each one's first word, row)."""
    counts = np.diff(first)
    each = np.maximum(counts - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), each)
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[:-1], each)
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        total = (total + hashes[at + k]) * _U(0xD6E8FEB86659FD93) + _U(k + 1)
    return mix64(total), at, rows


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges between successive entries of `first`."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[first[1:]] - total[first[:-1]]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column with counts[i] successive values in row i."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def in_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys that agree only within one row."""
    return mix64(hashes + mix64(rows.astype(np.uint64) + _U(0x5BD1E995)))


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: whether its key occurs more than once, and whether the same key occurs before it."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    before, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, before


@dataclass
class Lines:
    """Lines (parts between line feeds) that hold a word: byte spans, row, first and past-last word index."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    word_from: np.ndarray
    word_to: np.ndarray


def lines(w: Words) -> Lines:
    starts, ends, first = spans(w.data != 0x0A, w.offs)
    rows = np.repeat(np.arange(len(w.offs) - 1), np.diff(first))
    a, b = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
    full = b > a
    return Lines(starts[full], ends[full], rows[full], a[full], b[full])
