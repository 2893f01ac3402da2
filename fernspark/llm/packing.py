"""Sum-of-squares online packing of token ids into fixed windows.

Every scan partition packs its own documents, in order, with an array that counts the open windows at each fill level.
Whole windows of a long document are cut off first, then the rest is placed as one piece into the fill level (or a new
window) that minimises the sum of the squared counts of partially filled windows. The rule itself keeps few windows open (a few hundred);
so that a task's memory has a bound for any input, at most `open_windows` are: where the rule would open one more, the piece
is cut, and its head closes a window whose closing lowers the sum of squares most. When a partition ends, the
windows still open are emptied, fullest first, into full windows (cutting one piece at each seam), and the last tokens go
to windows whose lengths are powers of two, which need no padding. Nothing is shuffled, and padding does not depend on the
number of partitions.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import WHITE, blocks, run_hashes, text_buffers, words

WINDOW = 2048
END_ID = 1
#: Windows that a task holds open: 8 kB each, so 32 MB. The rule keeps a few hundred open; it is the memory's bound, not the rule's.
OPEN_WINDOWS = 4096
PIECES = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"
#: Distinct words that a task remembers the ids of, before it starts anew.
CACHE_WORDS = 400_000
#: Words handed to the library at once.
ENCODE_WORDS = 8192
#: Bytes of text encoded at once.
ENCODE_BYTES = 1 << 20


#: Bytes of letters: A-Z, a-z, and both bytes of U+00C0 to U+00FF but the signs U+00D7 and U+00F7.
_ASCII_LETTER = np.array([chr(b).isalpha() for b in range(128)] + [False] * 128)
_LATIN_TAIL = np.array([0x80 <= b < 0xC0 and b not in (0x97, 0xB7) for b in range(256)])


def byte_alphabet() -> dict[int, int]:
    """How byte-level BPE spells bytes as characters: printable ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts from ids of their parts, each distinct part encoded once.

    For tokenizers that lower letters, never let a piece span ASCII white space, and split runs of letters from all else
    (word_bpe_49k). A white-space separated word is cut into runs of letters and runs of other ASCII characters. Runs of
    letters go to the model as its pre-tokenizer would hand them over; other runs, and whole words with an apostrophe, a
    less-than sign (special tokens) or other characters, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spelling = byte_alphabet()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def parts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block with letters of letter runs lowered; starts, ends and whether letters of all parts; each row's first part."""
        w = words(data, offs)
        tail = np.zeros(len(data), bool)
        tail[1:] = (data[:-1] == 0xC3) & _LATIN_TAIL[data[1:]]
        letter = _ASCII_LETTER[data] | tail
        letter[:-1] |= tail[1:]
        odd = (data == 0x27) | (data == 0x3C) | ((data >= 0x80) & ~letter)
        total = np.concatenate([[0], np.cumsum(odd, dtype=np.int64)])
        strange = total[w.ends] > total[w.starts]
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, w.starts[strange], 1)
        np.add.at(inside, w.ends[strange], -1)
        letter &= np.cumsum(inside[:-1]) == 0
        start, end = np.zeros(len(data), bool), np.zeros(len(data) + 1, bool)
        start[w.starts], end[w.ends] = True, True
        change = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        change = change[~(WHITE[data[change]] | WHITE[data[change - 1]])]
        start[change], end[change] = True, True
        starts, ends = np.flatnonzero(start), np.flatnonzero(end)
        low = np.where(letter & ((data >= 65) & (data <= 90) | tail & (data >= 0x80) & (data <= 0x9E)), data + 32, data)
        return low, starts, ends, letter[starts], np.searchsorted(starts, offs)

    def _learn(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> None:
        coded: list[list[int]] = [[]] * len(keys)
        tokenize = self.tokenizer.model.tokenize
        for k in np.flatnonzero(letters).tolist():
            coded[k] = [t.id for t in tokenize(raw[starts[k] : ends[k]].decode("latin-1").translate(self.spelling))]
        rest = np.flatnonzero(~letters).tolist()
        for k in range(0, len(rest), ENCODE_WORDS):  # what the library returns for a word is far larger than its ids
            some = rest[k : k + ENCODE_WORDS]
            for i, x in zip(some, self.tokenizer.encode_batch_fast([raw[starts[i] : ends[i]].decode() for i in some], add_special_tokens=False)):
                coded[i] = x.ids
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(coded), np.uint32, int(size.sum()))])
        place = np.searchsorted(self.keys, keys)  # both are sorted
        self.keys, self.at, self.size = (np.insert(old, place, x) for old, x in ((self.keys, keys), (self.at, at), (self.size, size)))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and the offset of each row in them."""
        low, starts, ends, letters, row_first = self.parts(data, offs)
        keys = run_hashes(low, starts, ends, 8)
        keys, first, which = np.unique(np.where(letters, keys, ~keys), return_index=True, return_inverse=True)
        new = self._unknown(keys)
        if len(self.keys) + new.sum() > CACHE_WORDS and len(self.keys):
            self.clear()
            new[:] = True
        if new.any():
            at = first[new]
            self._learn(keys[new], low.tobytes(), starts[at], ends[at], letters[at])
        place = np.searchsorted(self.keys, keys)
        size, at = self.size[place][which], self.at[place][which]
        end = np.cumsum(size)
        ids = self.ids[np.arange(end[-1] if len(end) else 0) + np.repeat(at - (end - size), size)]
        return ids, np.concatenate([[0], end])[row_first]

    def _unknown(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys


class Packer:
    """Open windows by fill level. A piece is (document, start, ids); a closed window is a list of pieces."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.most = window, open_windows
        self.counts = np.zeros(window, np.int64)  # of open windows by fill; 0 stands for a new window
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.held = 0

    def _take(self, level: int) -> list:
        self.counts[level] -= 1
        self.held -= 1
        return self.open[level].pop()

    def _cheapest(self, n: int) -> int:
        """The fill level that a piece of n tokens goes to: 0 for a new window, -1 if that would be one too many."""
        size = self.window
        # Going from fill f to f + n changes the sum of squares by -(2 c[f] - 1) and + (2 c[f + n] + 1).
        change = np.empty(size - n + 1, np.int64)
        change[:-1] = 2 * self.counts[n:] + 1
        change[-1] = 0  # a full window is no longer counted
        change -= np.where(self.counts[: size - n + 1] > 0, 2 * self.counts[: size - n + 1] - 1, -(1 << 40))
        change[0] = 2 * self.counts[n] + 1 if self.held < self.most else 1 << 41
        best = int(len(change) - 1 - np.argmin(change[::-1]))  # of ties the fullest
        return best if change[best] < 1 << 40 else -1

    def place(self, piece: tuple) -> Iterator[list]:
        """Puts a piece of 1 to window - 1 tokens; yields the windows that are full now."""
        doc, start, ids = piece
        while len(ids):
            best = self._cheapest(len(ids))
            head = ids
            if best < 0:  # no window has room and no more may be opened: the head closes one
                best = int(self.window - 1 - np.argmax(self.counts[:0:-1]))
                head = ids[: self.window - best]
            pieces = self._take(best) if best else []
            pieces.append((doc, start, head))
            start, ids = start + len(head), ids[len(head) :]
            if best + len(head) == self.window:
                yield pieces
            else:
                self.counts[best + len(head)] += 1
                self.open[best + len(head)].append(pieces)
                self.held += 1

    def rest(self) -> Iterator[list]:
        """The open windows, emptied into full ones and into ones whose lengths are powers of two."""
        left = [p for f in range(self.window - 1, 0, -1) for w in self.open[f] for p in w]
        total = sum(len(p[2]) for p in left)
        sizes = [self.window] * (total // self.window) + [1 << b for b in reversed(range(self.window.bit_length())) if total % self.window >> b & 1]
        at = used = 0
        for size in sizes:
            pieces = []
            while size:
                doc, start, ids = left[at]
                head = ids[used : used + size]
                pieces.append((doc, start + used, head))
                size, used = size - len(head), used + len(head)
                if used == len(ids):
                    at, used = at + 1, 0
            yield pieces


def pack_partition(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int, open_windows: int) -> Iterator[pa.RecordBatch]:
    encoder, packer = _encoder(path), Packer(window, open_windows)
    task = TaskContext.get()
    sequence = (task.partitionId() if task else 0) << 32
    out: list[tuple] = []

    def emit(pieces: list) -> None:
        nonlocal sequence
        offset = 0
        for (doc_id, tokens), start, ids in pieces:
            out.append((doc_id, start, len(ids), ids, tokens, sequence, offset))
            offset += len(ids)
        sequence += 1

    def batch() -> pa.RecordBatch:
        cols = [*zip(*out)]
        sizes = np.array(cols[2], np.int32)
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(cols[3]).astype(np.int32)))
        arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), ids, *(pa.array(c, pa.int64()) for c in cols[4:])]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    for block in blocks(batches, limit=ENCODE_BYTES):
        ids, at = encoder.encode(*text_buffers(block.column(1)))
        for k, doc_id in enumerate(block.column(0).to_pylist()):
            own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id))
            doc, whole = (doc_id, len(own)), len(own) - len(own) % window
            for start in range(0, whole, window):
                emit([(doc, start, own[start : start + window])])
            for full in packer.place((doc, whole, own[whole:].copy())):  # a copy, so that an open window holds no whole document
                emit(full)
        if out:
            yield batch()
    encoder.clear()  # the worker process lives on
    for pieces in packer.rest():
        emit(pieces)
    if out:
        yield batch()


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    return _ENCODERS.setdefault(path, WordEncoder(path)) if path not in _ENCODERS else _ENCODERS[path]


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Every row of docs is a document, repeated rows and rows with a null doc_id too; null and empty texts are the end id
    alone. Sequences are full but for the last few of each partition, whose lengths are powers of two; sequence_id is the
    partition's number times 2**32 plus a running number. An empty table gives no rows. Only doc_id and text are looked at.
    tokenizer: the path of a tokenizers file, which every executor must have.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: pack_partition(it, tokenizer, window, end_id, open_windows), PIECES)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        raw, offs = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
        crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(offs, offs[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(crc, pa.int64()), *(batch.column(k) for k in range(4, 7))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 (of the little-endian 32-bit ids) in place of the ids."""
    return pieces.mapInArrow(_crc, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
