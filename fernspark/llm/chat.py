"""Chat formatting by columnar byte assembly, and the reader that turns the output back into turns.

A turn is written `<|im_start|>` role `\\n` text `<|im_end|>` `\\n`. Inside roles and texts every `<`, any backslashes, `|`
gets one backslash more (`<|` becomes `<\\|`), so no control string can come from a text; the reader takes it off again.
In roles, `\\` and a line feed are written `\\\\` and `\\n` before that. For a batch of turns the lengths of all segments,
their cumulative offsets and the places of headers and contents are computed in numpy, and bytes are scattered into one
buffer that becomes the Arrow column as it is. The loss mask is a list of byte spans: the text of each assistant turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import text_buffers

START, END = b"<|im_start|>", b"<|im_end|>"
#: Turns that one output batch holds, unless a conversation has more.
BATCH_TURNS = 20_000
_ESCAPE, _UNESCAPE = re.compile(rb"<(\\*)\|"), re.compile(rb"<\\(\\*)\|")
_TURN = re.compile(rb"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
FORMATTED = "conv_id long, formatted string, mask_start array<long>, mask_length array<long>"


def escape(text: bytes) -> bytes:
    return _ESCAPE.sub(rb"<\\\1|", text)


def unescape(text: bytes) -> bytes:
    return _UNESCAPE.sub(rb"<\1|", text)


def escape_role(role: bytes) -> bytes:
    return escape(role.replace(b"\\", b"\\\\").replace(b"\n", b"\\n"))


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(role))


def _escaped(column: pa.Array) -> pa.Array:
    """The column as binary, nulls empty, escaped where it has to be."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    hit = pc.match_substring_regex(column, r"<\\*\|")
    if pc.any(hit).as_py():
        column = pa.array([escape(x.encode()) if h else x.encode() for x, h in zip(column.to_pylist(), hit.to_pylist())], pa.large_binary())
    return column.cast(pa.large_binary())


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offs: np.ndarray) -> None:
    """Copies segment i of data to out[at[i]:]."""
    lens = np.diff(offs)
    if lens.sum():
        out[np.arange(offs[-1]) + np.repeat(at - offs[:-1], lens)] = data


def assemble(conv: pa.Array, role: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """Turns of whole conversations, in order, as one row per conversation."""
    n = len(conv)
    names = pc.fill_null(role.cast(pa.large_string()), "").dictionary_encode()
    kinds = [x.encode() for x in names.dictionary.to_pylist()]
    heads = [START + escape_role(x) + b"\n" for x in kinds]
    which = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    data, offs = text_buffers(_escaped(text).view(pa.large_string()))
    head_len, tail = np.array([len(x) for x in heads], np.int64)[which], END + b"\n"
    lens = np.diff(offs)
    total = head_len + lens + len(tail)
    begin = np.cumsum(total) - total
    out = np.empty(int(total.sum()), np.uint8)
    head_data = np.frombuffer(b"".join(heads), np.uint8)
    head_at = np.concatenate([[0], np.cumsum([len(x) for x in heads])])
    src = np.arange(head_len.sum()) + np.repeat(head_at[which] - (np.cumsum(head_len) - head_len), head_len)
    _scatter(out, begin, head_data[src], np.concatenate([[0], np.cumsum(head_len)]))
    _scatter(out, begin + head_len, data, offs)
    _scatter(out, begin + head_len + lens, np.tile(np.frombuffer(tail, np.uint8), n), np.arange(n + 1) * len(tail))
    keys = conv.fill_null(0).to_numpy(zero_copy_only=False)
    null = conv.is_null().to_numpy(zero_copy_only=False)
    change = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])]))
    row_offs = np.concatenate([begin[change], [len(out)]]).astype(np.int64)
    formatted = pa.LargeStringArray.from_buffers(len(change), pa.py_buffer(row_offs), pa.py_buffer(out))
    spoken = np.array([x == b"assistant" for x in kinds], bool)[which]
    row = np.repeat(np.arange(len(change)), np.diff(np.concatenate([change, [n]])))
    span = (begin + head_len - row_offs[row])[spoken]
    counts = np.bincount(row[spoken], minlength=len(change))
    list_offs = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(list_offs, pa.array(x, pa.int64())) for x in (span, lens[spoken])]
    return pa.RecordBatch.from_arrays([conv.take(pa.array(change)), formatted.cast(pa.string()) if len(out) < 2**31 else formatted, *lists], names=["conv_id", "formatted", "mask_start", "mask_length"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < BATCH_TURNS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        conv = table.column("conv_id").combine_chunks()
        last = conv[-1]
        same = conv.is_null() if not last.is_valid else pc.fill_null(pc.equal(conv, last), False)
        cut = pc.index(same, True).as_py()
        held = table.slice(cut).to_batches()
        if cut:
            yield assemble(*(table.slice(0, cut).column(c).combine_chunks() for c in ("conv_id", "role", "text")))
    if held:
        table = pa.Table.from_batches(held)
        yield assemble(*(table.column(c).combine_chunks() for c in ("conv_id", "role", "text")))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, mask_start and mask_length (byte spans of the assistant texts) for each conversation.

    Turns are in the order of `turn`, then role, then text; null turns come first; repeated rows are repeated turns. Null
    texts and roles are empty. Rows whose conv_id is null are one conversation. An empty table gives no rows. Only the
    four columns conv_id, turn, role and text are looked at.
    """
    dealt = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format, FORMATTED)


def read_chat(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) turns of one formatted conversation."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, text, starts, lens in zip(*(batch.column(k).to_pylist() for k in range(4))):
            raw = text.encode()
            turns = read_chat(raw)
            loss = b"".join(unescape(raw[a : a + n]) for a, n in zip(starts, lens))
            rows.append((conv, len(turns), hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in turns)).hexdigest(), len(loss.decode()), hashlib.sha256(loss).hexdigest(), len(text)))
        columns = [*zip(*rows)] if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted output says, per conversation."""
    columns = formatted.select("conv_id", "formatted", "mask_start", "mask_length")
    return columns.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
