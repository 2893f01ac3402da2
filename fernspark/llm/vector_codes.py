"""Vector code compression: codebooks by part, whose searches are ordered and pruned by fixed pivots.

Each component becomes an integer, floor(1024 x), each vector is cut into equal parts, and each part gets the index of its
nearest codebook entry; codebooks start as the parts of the first vectors and are refined for some rounds.

1. The first vectors (the smallest vec_ids) become the entries. A few of them, each the farthest from those before it, are
   the pivots of their part, and stay so.
2. One pass computes the distance of every part to its pivots, and writes integers and distances to a staged table.
3. A round first computes the distances between pivots and entries. By the triangle inequality the difference of the two
   is a lower bound of a part's distance to an entry. Entries are evaluated exactly, in integers, in the order of that
   bound, until the next bound lies beyond the best distance. Each task adds up its parts by entry; what comes to the
   driver is one row per part and entry, and the new codebooks go out with the next round's tasks.
4. Parts are assigned once more, by the same search, against the final entries.

Rounds are narrow passes over the table but for the sums, of which each task has at most entries x dimension numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import discard, staged

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
PIVOTS = 8
#: Parts searched at once: the bounds of so many take 4 MB at 256 entries.
BLOCK_ROWS = 2048
#: Entries evaluated in the first step of a search; each step takes twice as many as the one before.
FIRST_STEP = 8
#: Labels whose sums are broadcast: 16 bytes each.
FEW_LABELS = 200_000


@dataclass
class Codebooks:
    """parts arrays of entries x width integers, and the pivots of each part."""

    entries: list[np.ndarray]
    pivots: list[np.ndarray]

    def sha256(self) -> str:
        """Hex digest of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (integers) of the rows whose vector is not null and holds finite components only."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("embedding").isNotNull() & ~bad)
    return kept.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(SCALE * x)).alias("v"))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two integer matrices."""
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(2).astype(np.float64))


def farthest(entries: np.ndarray, n: int) -> np.ndarray:
    """At most n entries: the first, then each time the one farthest from all before (ties: the lower index)."""
    chosen = [0]
    near = distances(entries, entries[:1])[:, 0]
    while len(chosen) < n and near.max(initial=0) > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen]


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, between: np.ndarray, evaluated: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (ties: the lower index), and the squared distance, both exact.

    to_pivots: distances of the rows to the pivots; between: of the pivots to the entries. evaluated: gets the number of
    exact evaluations.
    """
    n = len(entries)
    lower = np.zeros((len(x), n))
    for p in range(len(between)):
        np.maximum(lower, np.abs(to_pivots[:, p, None] - between[p]), out=lower)
    order = np.argsort(lower, axis=1, kind="stable")
    # Square roots are off by a unit in the last place at most: so much may lie between a bound and the truth.
    slack = 1e-9 + 1e-12 * (to_pivots.max(initial=0) + between.max(initial=0))
    best, code = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), n)
    rows, at, step = np.arange(len(x)), 0, FIRST_STEP
    while len(rows) and at < n:
        some = order[rows, at : at + step]
        squared = ((x[rows, None] - entries[some]) ** 2).sum(2)
        if evaluated is not None:
            evaluated.append(some.size)
        least = squared.min(1)
        index = np.where(squared == least[:, None], some, n).min(1)
        better = (least < best[rows]) | (least == best[rows]) & (index < code[rows])
        best[rows[better]], code[rows[better]] = least[better], index[better]
        at, step = at + step, 2 * step
        if at < n:
            rows = rows[lower[rows, order[rows, at]] <= np.sqrt(best[rows].astype(np.float64)) + slack]
    return code, best


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A list column whose lists have one length."""
    values = np.asarray(column.flatten()).astype(kind, copy=False)
    return values.reshape(len(column), -1) if len(column) and len(values) else np.zeros((len(column), 0), kind)


def _prepare(kept: DataFrame, books: Codebooks) -> DataFrame:
    """The rows with the distances of their parts to the pivots."""
    width, pivots = books.entries[0].shape[1], books.pivots

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2), np.int64)
            each = [distances(v[:, k * width : (k + 1) * width], p) for k, p in enumerate(pivots)]
            every = np.concatenate(each, 1) if batch.num_rows else np.zeros((0, 0))
            offs = np.arange(batch.num_rows + 1) * every.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(every.ravel()))], names=["vec_id", "label", "v", "d"])

    types = dict(kept.dtypes)
    return staged(kept.mapInArrow(measure, f"vec_id {types['vec_id']}, label {types['label']}, v array<long>, d array<double>"), "vectors")


def _searches(batch: pa.RecordBatch, v_at: int, books: Codebooks, between: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For every stretch of rows and part: first row, part, its integers, codes and squared distances."""
    v, d = _matrix(batch.column(v_at), np.int64), _matrix(batch.column(v_at + 1), np.float64)
    width = books.entries[0].shape[1]
    firsts = np.cumsum([0, *(len(p) for p in books.pivots)])
    for at in range(0, batch.num_rows, BLOCK_ROWS):
        for part, entries in enumerate(books.entries):
            x = v[at : at + BLOCK_ROWS, part * width : (part + 1) * width]
            yield at, part, x, *nearest(x, d[at : at + BLOCK_ROWS, firsts[part] : firsts[part + 1]], entries, between[part])


def _between(books: Codebooks) -> list[np.ndarray]:
    return [distances(p, e) for p, e in zip(books.pivots, books.entries)]


def _refine(prepared: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round."""
    between, (n, width) = _between(books), books.entries[0].shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(books.entries)
        counts, sums = np.zeros((parts, n), np.int64), np.zeros((parts, n, width), np.int64)
        for batch in batches:
            for _, part, x, code, _ in _searches(batch, 0, books, between):
                counts[part] += np.bincount(code, minlength=n)
                np.add.at(sums[part], code, x)
        part, entry = np.nonzero(counts)
        total = sums[part, entry]
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(part) + 1) * width).astype(np.int32)), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), lists], names=["part", "entry", "n", "s"])

    added = prepared.select("v", "d").mapInArrow(add, "part long, entry long, n long, s array<long>")
    by_place = added.select("part", "entry", "n", F.posexplode_outer("s").alias("place", "s")).groupBy("part", "entry", "place")
    totals = by_place.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    rows = totals.groupBy("part", "entry").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda x: x["s"]).alias("s"))
    entries = [x.copy() for x in books.entries]
    for r in rows.collect():  # parts x entries rows at most
        if width:
            entries[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["s"]]
    return Codebooks(entries, books.pivots)


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[Codebooks | None, DataFrame | None]:
    """The codebooks after all rounds, and the table of vectors to encode (staged); None for an empty table. kept: as of kept_vectors."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # `entries` vectors at most
    if not first:
        return None, None
    lengths = {len(r["v"]) for r in first}
    size = lengths.pop()
    if lengths or size % parts:
        raise ValueError(f"vectors need one length, a multiple of {parts}")
    most = int((2**62 / max(size, 1)) ** 0.5 / 2)  # so that squared distances fit in 64 bits

    def checked(v: Column) -> Column:
        fits = (F.size(v) == size) & ~F.exists(v, lambda x: F.abs(x) > most)
        return F.when(fits, v).otherwise(F.raise_error(F.lit(f"a vector has not {size} components, or one beyond {most / SCALE:g}")).cast("array<bigint>"))

    kept = kept.select("vec_id", "label", checked(F.col("v")).alias("v"))
    if any(abs(x) > most for r in first for x in r["v"]):
        raise ValueError(f"a vector has a component beyond {most / SCALE:g}")
    start = [np.array([r["v"] for r in first], np.int64).reshape(len(first), -1)[:, k * (size // parts) : (k + 1) * (size // parts)] for k in range(parts)]
    books = Codebooks(start, [farthest(x, pivots) for x in start])
    prepared = _prepare(kept, books)
    for _ in range(rounds):
        books = _refine(prepared, books)
    return books, prepared


def encode(prepared: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (binary: one byte per part, or two, big-endian, with over 256 entries), error (squared distances added over parts)."""
    between = _between(books)
    kind = ">u1" if len(books.entries[0]) <= 256 else ">u2"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = np.zeros((batch.num_rows, len(books.entries)), kind), np.zeros(batch.num_rows, np.int64)
            for at, part, x, code, squared in _searches(batch, 2, books, between):
                codes[at : at + len(x), part] = code
                error[at : at + len(x)] += squared
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    types = dict(prepared.dtypes)
    return prepared.mapInArrow(search, f"vec_id {types['vec_id']}, label {types['label']}, code binary, error long")


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """One row per kept row of vectors: vec_id, label, code (binary), error, label_error, codebooks_sha256.

    vectors: vec_id, embedding (an array of numbers), label; other columns are not looked at. Rows whose vector is null, or
    holds a null, NaN or infinite component, are dropped; rows with a null vec_id or label are kept. Repeated rows are coded
    each. The entries start as the vectors of the smallest vec_ids (null: after all others; ties: by the vector), fewer
    than `entries` if the table has fewer. Vectors need one length, a multiple of `parts` (0 too), and components small
    enough for squared distances of 64 bits; others end the job with an error. label_error adds up errors over rows of an
    equal label, null labels together. An empty table, or one without kept rows, gives no rows.
    """
    kept = kept_vectors(vectors)
    books, prepared = fit(kept, parts, entries, rounds, pivots)
    if books is None:
        types = dict(kept.dtypes)
        return vectors.sparkSession.createDataFrame([], f"vec_id {types['vec_id']}, label {types['label']}, code binary, error long, label_error long, codebooks_sha256 string")
    coded = staged(encode(prepared, books), "codes")
    discard(prepared)
    by_label = staged(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    few = by_label.count() <= FEW_LABELS
    out = coded.join(F.broadcast(by_label) if few else by_label, coded["label"].eqNullSafe(F.col("of_label")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
