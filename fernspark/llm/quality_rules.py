"""Quality rules: base counts of each document, and lines that too many documents of one host share.

Lines are normalised (A-Z lowered, digits to 0, only the words count) and hashed; for each host (`source`) the distinct
documents that hold a line are counted, where documents are told apart by a hash of their whole text, so that exact copies
are one document. Lines found in more than `max_documents` documents of a host are removed, and a document that loses more
than `max_removed` of its words is depleted and rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._kernels import LOWER, blocks, code_points, in_row, lines, list_array, repeats, run_hashes, segment_sums, text_buffers, windows, words
from ._spark import staged

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
FOLD = LOWER.copy()
FOLD[48:58] = 48
MAX_DOCUMENTS = 25
MAX_REMOVED = 0.5
COUNTS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SCAN = f"row long, {COUNTS}, mark long, lines array<long>, line_words array<int>"


def line_hashes(w, ln) -> np.ndarray:
    """Hashes of normalised lines: of their words, with letters lowered and digits folded."""
    each = run_hashes(FOLD[w.data], w.starts, w.ends, 2)
    counts = ln.word_to - ln.word_from
    place = np.arange(len(each)) - np.repeat(ln.word_from, counts)
    return np.add.reduceat(in_row(each, place), ln.word_from) if len(ln.starts) else np.zeros(0, np.uint64)


def text_marks(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of each row's whole text; 0 for empty ones."""
    out = np.zeros(len(offs) - 1, np.uint64)
    full = np.diff(offs) > 0
    out[full] = run_hashes(data, offs[:-1][full], offs[1:][full], 4)
    return out


def base_counts(w) -> dict[str, np.ndarray]:
    n = len(w.offs) - 1
    hashes = run_hashes(w.data, w.starts, w.ends, 1)
    grams, at, rows = windows(hashes, w.first, 3)
    twice, _ = repeats(in_row(grams, rows))
    covered = np.zeros(len(hashes) + 3, bool)
    for k in range(3):
        covered[at[twice] + k] = True
    ln = lines(w)
    whole = run_hashes(w.data, ln.starts, ln.ends, 3)
    _, before = repeats(in_row(whole, ln.rows))
    points = np.concatenate([[0], np.cumsum(code_points(w.data), dtype=np.int64)])
    return {
        "n_words": w.counts, "word_chars": segment_sums(points[w.ends] - points[w.starts], w.first), "n_symbols": segment_sums(SYMBOLS[w.data], w.offs),
        "n_dup_lines": np.bincount(ln.rows[before], minlength=n), "n_repeat_words": segment_sums(covered[: len(hashes)], w.first),
    }


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    row = (task.partitionId() if task else 0) << 33
    for block in blocks(batches):
        w = words(*text_buffers(block.column(2)))
        n = block.num_rows
        ln = lines(w)
        hashes, size = line_hashes(w, ln), ln.word_to - ln.word_from
        # Distinct lines of each row, with the words that all their repeats hold.
        _, first, group = np.unique(in_row(hashes, ln.rows), return_index=True, return_inverse=True)
        total = np.bincount(group, weights=size, minlength=len(first)).astype(np.int64)
        order = np.argsort(ln.rows[first], kind="stable")
        first, total = first[order], total[order]
        counts = np.bincount(ln.rows[first], minlength=n)
        base = base_counts(w)
        arrays = [pa.array(np.arange(row, row + n)), block.column(0), block.column(1), *(pa.array(base[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
        arrays += [pa.array(text_marks(w.data, w.offs).astype(np.int64)), list_array(hashes[first].astype(np.int64), counts, pa.int64()), list_array(total.astype(np.int32), counts, pa.int32())]
        row += n
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _SCAN.split(", ")])


def quality_rules(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_removed: float = MAX_REMOVED, host_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, removed_words, removed_lines (hashes), kept.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. kept: neither base_failed nor
    depleted. Null texts count as empty; a null host is a host of its own; repeated rows and other rows of equal texts each
    get a row and count as one document in line frequencies. An empty table gives no rows. Other columns are not looked at.
    """
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    scan = staged(columns.mapInArrow(_scan, _SCAN), "quality-rules")
    host = F.coalesce("host", F.lit("\0")).alias("host")
    each = scan.select("row", host, "mark", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    each = each.select("row", "host", "mark", F.col("x.lines").alias("line"), F.col("x.line_words").alias("size"))
    holders = each.groupBy("host", "line", "mark").agg(F.count(F.lit(1)).alias("rows"))  # a line's documents spread over tasks
    common = holders.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") > max_documents).select("host", "line")
    lost = each.join(common, ["host", "line"]).groupBy("row").agg(F.sum("size").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    out = scan.drop("lines", "line_words", "mark", "host").join(lost, "row", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long"))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & (F.col("removed_words") <= max_removed * F.col("n_words"))).drop("row")


def clean_text(text: Column, removed_lines: Column) -> Column:
    """The text without the lines whose hashes are in removed_lines (an array from quality_rules; null: none); a null text stays null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(texts, removed):
            if text is None or gone is None or not len(gone):
                out.append(text)
                continue
            parts = text.split("\n")
            w = words(*text_buffers(pa.array(parts)))
            ln = lines(w)
            drop = set(ln.rows[np.isin(line_hashes(w, ln).astype(np.int64), np.asarray(gone))].tolist())
            out.append("\n".join(x for k, x in enumerate(parts) if k not in drop))
        return pd.Series(out)

    return cut(text, removed_lines)
