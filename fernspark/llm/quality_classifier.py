"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic scores.

Each document becomes a fixed row of statistics of its text alone. Random Fourier features approximate a Gaussian kernel
over the standardised statistics. Partitions add up their part of the normal equations, which are summed by matrix row on
the executors; only the summed matrix, whose size the number of features fixes, comes to the driver. Raw scores are
calibrated by isotonic regression over a fixed number of score bins, on labelled rows that the fit has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._kernels import WHITE, blocks, code_points, in_row, lines, repeats, run_hashes, segment_sums, text_buffers, windows, words
from ._spark import staged

FEATURES = 256
BANDWIDTH = 4.0
RIDGE = 1.0
BINS = 512
CUT = 0.7
_IN = {k: np.isin(np.arange(256), list(v)) for k, v in {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&|<>", "shout": b"!?",
    "stop": b".", "comma": b",;:", "bracket": b"()[]{}/\\_=+~^@", "quote": b"'\"`-"}.items()}


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of document statistics per text; an empty text has all zeros."""
    w = words(data, offs)
    n, rows = len(offs) - 1, w.rows
    count = np.maximum(w.counts, 1)
    points = code_points(data)
    chars = np.maximum(segment_sums(points, offs), 1)
    share = lambda mask: segment_sums(mask[data], offs) / chars
    total = np.concatenate([[0], np.cumsum(points, dtype=np.int64)])
    size = (total[w.ends] - total[w.starts]).astype(float)
    mean = segment_sums(size, w.first) / count
    hashes = run_hashes(data, w.starts, w.ends, 1)
    twice, before = repeats(in_row(hashes, rows))
    grams, _, gram_rows = windows(hashes, w.first, 3)
    gram_twice, _ = repeats(in_row(grams, gram_rows))
    pair = np.zeros(len(rows), bool)
    pair[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    ln = lines(w)
    n_lines = np.maximum(np.bincount(ln.rows, minlength=n), 1)
    _, line_before = repeats(in_row(run_hashes(data, ln.starts, ln.ends, 3), ln.rows))
    last = data[w.ends - 1] if len(rows) else np.zeros(0, np.uint8)
    head = data[w.starts] if len(rows) else np.zeros(0, np.uint8)
    by_word = lambda mask: segment_sums(mask, w.first) / count
    columns = [
        np.log1p(w.counts), mean, np.sqrt(np.maximum(segment_sums(size * size, w.first) / count - mean * mean, 0)), by_word(size <= 3), by_word(size >= 12),
        *(share(_IN[k]) for k in _IN), share(WHITE), segment_sums(~points, offs) / chars, share(np.arange(256) < 32),
        by_word(before), by_word(twice), np.bincount(gram_rows[gram_twice], minlength=n) / count, by_word(pair),
        np.log1p(n_lines * (w.counts > 0)), np.bincount(ln.rows[line_before], minlength=n) / n_lines, np.log1p(w.counts / n_lines),
        by_word(_IN["symbol"][last]), by_word(_IN["shout"][last]), by_word(_IN["stop"][last] | _IN["comma"][last]), by_word(_IN["upper"][head]),
        by_word(~(_IN["lower"] | _IN["upper"] | (np.arange(256) >= 128))[head]),
    ]
    return np.where(w.counts[:, None] > 0, np.stack(columns, 1), 0.0)


WIDTH = statistics(np.frombuffer(b"a", np.uint8), np.array([0, 1])).shape[1]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None
    edges: np.ndarray
    levels: np.ndarray

    def project(self, stats: np.ndarray) -> np.ndarray:
        """Features in steps of 2**-14: sums of their products are exact, so the fit does not depend on the order of rows."""
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        out = np.concatenate([np.ones((len(z), 1)), z / np.sqrt(WIDTH), np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))], 1)
        return np.round(out * 16384) / 16384

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.project(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0.0, 1.0)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the identifier as text, modulo 4; 0 for a null identifier."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)).cast("int"), F.lit(0))


def pool_adjacent(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic (non-decreasing) means of successive groups with `counts` rows and `ones` positive rows."""
    stack: list[list[float]] = []
    for a, n in zip(ones, counts):
        stack.append([a, n, 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            a, n, k = stack.pop()
            stack[-1] = [stack[-1][0] + a, stack[-1][1] + n, stack[-1][2] + k]
    return np.repeat([a / n for a, n, _ in stack], [k for *_, k in stack])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        stats = statistics(*text_buffers(block.column(1)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, WIDTH, dtype=np.int32)), pa.array(stats.ravel()))
        yield pa.RecordBatch.from_arrays([block.column(0), lists], names=["doc_id", "stats"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, WIDTH)


def fit(docs: DataFrame, labels: DataFrame, features: int = FEATURES, seed: int = 7) -> QualityModel:
    """A model from the labelled rows of docs outside fold 2: folds 0 and 1 fit the ridge, fold 3 calibrates.

    Labels other than 0 and 1 are ignored; of several labels of one document the largest counts. Without labelled rows in
    the fit folds there are no weights and every score is 0.5. Without calibration rows the fit's own rows calibrate.
    """
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(fold() != 2)
    rows = staged(texts.mapInArrow(_statistics, "doc_id long, stats array<double>").join(known, "doc_id").withColumn("fold", fold()), "quality-statistics")
    train = rows.filter("fold < 2")
    rng = np.random.default_rng(seed)
    moments = train.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # one row per statistic
    few = lambda x: float(f"{x:.6g}")  # noqa: E731  digits that the order of summing doesn't reach
    mean = np.array([few(r["m"]) for r in moments]) if moments else np.zeros(WIDTH)
    scale = np.array([few(r["s"]) if r["s"] and r["s"] > 1e-9 else 1.0 for r in moments]) if moments else np.ones(WIDTH)
    model = QualityModel(mean, scale, rng.normal(size=(WIDTH, features)) / BANDWIDTH, rng.uniform(0, 2 * np.pi, features), None, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    if not moments:
        return model

    def normal(batches):
        total = None
        for b in batches:
            if b.num_rows:
                z = model.project(_matrix(b.column(0)))
                part = np.concatenate([z.T @ z, (z.T @ np.asarray(b.column(1), dtype=float))[:, None]], 1)
                total = part if total is None else total + part
        if total is not None:
            d = total.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, d, dtype=np.int32)), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), lists], names=["i", "part"])

    def add(key, table):
        part = table.column("part").combine_chunks()
        total = np.asarray(part.flatten()).reshape(len(part), -1).sum(0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = train.select("stats", "y").mapInArrow(normal, "i int, part array<double>").groupBy("i").applyInArrow(add, "i int, part array<double>")
    summed = np.array([r["part"] for r in sorted(parts.collect(), key=lambda r: r["i"])])  # (features + WIDTH + 1) rows
    gram, right = summed[:, :-1], summed[:, -1]
    penalty = np.full(len(gram), RIDGE)
    penalty[0] = 1e-6
    weights = np.linalg.solve(gram + np.diag(penalty), right)
    model = QualityModel(*(getattr(model, k) for k in ("mean", "scale", "directions", "phases")), weights, model.edges, model.levels)

    def binned(batches):
        for b in batches:
            at = np.clip(((model.raw(_matrix(b.column(0))) + 0.5) * BINS / 2).astype(np.int32), 0, BINS - 1) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1)], names=["bin", "y"])

    def bins(part):
        counts = part.select("stats", "y").mapInArrow(binned, "bin int, y int").groupBy("bin").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("rows"))
        return sorted(map(tuple, counts.collect()))  # at most BINS rows

    found = bins(rows.filter("fold = 3")) or bins(train)
    at, ones, counts = map(np.array, zip(*found))
    levels = pool_adjacent(ones.astype(float), counts.astype(float))
    return QualityModel(model.mean, model.scale, model.directions, model.phases, weights, (at + 0.5) * 2 / BINS - 0.5, levels)


def score(docs: DataFrame, model: QualityModel, cut: float = CUT) -> DataFrame:
    """docs with score (0 to 1; null text: as an empty one) and predicted (1 if score >= cut), in one narrow pass.

    Every row is scored, repeated rows alike; columns named score or predicted are replaced; an empty table stays empty.
    """
    docs = docs.drop("score", "predicted")
    names = docs.columns
    text = names.index("text")

    def run(batches):
        for block in blocks(batches):
            value = model.score(statistics(*text_buffers(block.column(text).cast(pa.string()))))
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(value), pa.array((value >= cut).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score and predicted of a model fitted on their own labelled rows."""
    return score(docs, fit(docs, labels))
