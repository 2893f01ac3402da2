"""Cross-entropy difference between a target and a background language model.

Both are word bigram models over one vocabulary, the `vocabulary` most frequent words of all documents; other words fall
into 32 classes by length and kinds of characters. The background is all documents, the target those that are listed; both
have the same form and smoothing (Witten-Bell over add-one unigrams). A document is scored by counts from which its own are
taken away, in each model that it is part of. Its score is the mean over its tokens of target loss minus background loss
(nats): the lower, the more it resembles the target.

1. Words are counted over all texts; the most frequent ones are the vocabulary.
2. Texts become token codes, dealt into blocks of about `BLOCK` bytes of text, in a staged table.
3. Bigrams are counted in a table, within each task first. It grows with the corpus and is never collected; what comes to
   the driver is the vocabulary and the totals by word, whose sizes `vocabulary` fixes.
4. Each block asks the table for its distinct bigrams, in one join, and its documents are scored where the answers meet.
   Bigrams that the corpus has once need no answer: their only document takes its own count away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import LOWER, blocks, run_hashes, text_buffers, words
from ._spark import discard, staged

VOCABULARY = 8192
SHAPES = 32
BLOCK = 8 << 20
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_SIGN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def shapes(w) -> np.ndarray:
    """Class of each word by its length in bytes and by whether it has digits, signs, and characters beyond ASCII."""
    size = w.ends - w.starts
    out = np.searchsorted([4, 7, 11], size, side="right")
    for k, mask in enumerate((_DIGIT[w.data], _SIGN[w.data], w.data >= 128)):
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        out = out + (4 << k) * (total[w.ends] > total[w.starts])
    return out


def tokens(data: np.ndarray, offs: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words (1 .. V: vocabulary, then shape classes; 0 stands before a text), and each row's first word."""
    w = words(LOWER[data], offs)
    codes = len(vocabulary) + 1 + shapes(w)
    if len(vocabulary):
        hashes = run_hashes(w.data, w.starts, w.ends, 1).astype(np.int64)
        place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        codes = np.where(vocabulary[place] == hashes, place + 1, codes)
    return codes.astype(np.uint16), w.first


def bigrams(codes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """The bigram that ends at each token: code before * size + code."""
    before = np.zeros(len(codes), np.int64)
    before[1:] = codes[:-1]
    before[first[:-1][np.diff(first) > 0]] = 0
    return before * size + codes


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for block in blocks(batches):
        w = words(*_lowered(block.column(0)))
        found, n = np.unique(run_hashes(w.data, w.starts, w.ends, 1).astype(np.int64), return_counts=True)
        keys, counts = _added(keys, counts, found, n)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["word", "n"])


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = text_buffers(column)
    return LOWER[data], offs


def _added(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted key lists with counts (rows of counts), as one."""
    every, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
    out = np.zeros((len(every), *counts.shape[1:]), np.int64)
    np.add.at(out, where[: len(keys)], counts)
    np.add.at(out, where[len(keys) :], n)
    return every, out


def frequent_words(texts: DataFrame, size: int) -> np.ndarray:
    """Hashes of the most frequent words (ties: the smaller hash), sorted.

    Words are first counted by the power of two that their count has, at most 64 rows, so that only words of the powers that
    can be among the most frequent are ordered.
    """
    counts = staged(texts.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    power = F.floor(F.log2("n")).cast("int")
    low, held = 0, 0
    for r in sorted(counts.groupBy(power.alias("p")).count().collect(), reverse=True):
        low, held = r["p"], held + r["count"]
        if held >= size:
            break
    top = counts.filter(power >= low).orderBy(F.desc("n"), "word").limit(size).collect()
    discard(counts)
    return np.sort(np.array([r["word"] for r in top], np.int64))


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token codes of a binary column and each row's first token."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts = [np.frombuffer(x, np.uint16) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16), np.cumsum([0, *map(len, parts)])


def losses(c, total, types, unigram):
    """-log of the interpolated probability: bigram count, its history's total and types, and the word's own probability."""
    n = total + types
    return -np.log(np.where(n > 0, (c + types * unigram) / np.maximum(n, 1), unigram))


def mean_losses(codes: np.ndarray, first: np.ndarray, member: np.ndarray, grams: np.ndarray, counts: np.ndarray, by_history: tuple[np.ndarray, np.ndarray], by_word: np.ndarray) -> np.ndarray:
    """Mean loss of each row of a block under one model, without the counts of rows that are members of its corpus.

    grams (sorted), counts: the model's counts of the block's bigrams, without those of which the corpus has one only, so that
    nothing is left of them in the row that has it; by_history: totals and types; by_word: counts.
    """
    size, n = len(by_word), np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    keys, where, own = np.unique(rows * (size * size) + bigrams(codes, first, size), return_inverse=True, return_counts=True)
    row, gram = keys // (size * size), keys % (size * size)
    own = own * member[row]
    place = np.minimum(np.searchsorted(grams, gram), max(len(grams) - 1, 0))
    held = np.where(grams[place] == gram, counts[place], own) if len(grams) else own

    def in_row(values, weights):  # sums over the row's bigrams with the same value (history or word)
        _, group = np.unique(row * size + values, return_inverse=True)
        return np.bincount(group, weights=weights)[group] if len(values) else np.zeros(0)

    history, word = gram // size, gram % size
    total = by_history[0][history] - in_row(history, own)
    types = by_history[1][history] - in_row(history, (held > 0) & (held == own))
    unigram = (by_word[word] - in_row(word, own) + 1) / (by_word.sum() - (n * member)[row] + size)
    each = losses(held - own, total, types, unigram)
    sums = np.bincount(rows, weights=each[where], minlength=len(n))
    return np.divide(sums, n, out=np.full(len(n), np.nan), where=n > 0)


def score_documents(docs: DataFrame, target: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, target_loss, background_loss (means per token), score (their difference).

    docs: doc_id, text, all of them the background; target: doc_id of the documents of the target. Null and empty texts have
    0 tokens and null losses. Repeated rows are told apart, so each takes away its own counts only; a null doc_id is never
    in the target. If the target is empty its model knows nothing. An empty table gives no rows. Other columns are not
    looked at. vocabulary: at most 65,000.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = frequent_words(texts, vocabulary)
    size = len(known) + 1 + SHAPES

    def encode(batches):
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 33
        for block in blocks(batches, limit=BLOCK):
            codes, first = tokens(*text_buffers(block.column(1)), known)
            each = pa.array([codes[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(block.num_rows, number)), block.column(0), each], names=["block", "doc_id", "codes"])
            number += 1

    coded = staged(texts.select("doc_id", "text").mapInArrow(encode, "block long, doc_id long, codes binary"), "tokens")
    listed = target.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("in_target")).filter("doc_id IS NOT NULL").distinct()
    few = listed.count() <= 200_000  # 1.6 MB of identifiers
    flagged = coded.join(F.broadcast(listed) if few else listed, "doc_id", "left").select("block", "doc_id", "codes", F.coalesce("in_target", F.lit(0)).alias("in_target"))

    def count(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        for b in batches:
            codes, first = _codes(b.column(0))
            of_target = np.repeat(np.asarray(b.column(1)), np.diff(first))
            found, where = np.unique(bigrams(codes, first, size), return_inverse=True)
            n = np.stack([np.bincount(where, weights=of_target, minlength=len(found)), np.bincount(where, minlength=len(found))], 1).astype(np.int64)
            keys, counts = _added(keys, counts, found, n)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=["gram", "t", "b"])

    counted = flagged.select("codes", "in_target").mapInArrow(count, "gram long, t long, b long")
    model = staged(counted.groupBy("gram").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "bigrams")

    def totals(key):  # at most `size` rows
        out = np.zeros((4, size), np.int64)
        sums = [F.sum("t"), F.sum("b"), F.sum((F.col("t") > 0).cast("long")), F.count(F.lit(1))]
        for r in model.groupBy(key.cast("int").alias("k")).agg(*(s.alias(f"s{k}") for k, s in enumerate(sums))).collect():
            out[:, r["k"]] = r[1:]
        return out

    history, word = totals(F.floor(F.col("gram") / size)), totals(F.col("gram") % size)

    def ask(batches):
        for b in batches:
            block = np.asarray(b.column(0))
            codes, first = _codes(b.column(1))
            edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else np.zeros(1, int)
            for a, z in zip(edges, edges[1:]):
                at = first[a : z + 1]
                grams = np.unique(bigrams(codes[at[0] : at[-1]], at - at[0], size))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block[a])), pa.array(grams)], names=["block", "gram"])

    answers = coded.select("block", "codes").mapInArrow(ask, "block long, gram long").join(model.filter("b > 1"), "gram")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, first = _codes(left.column("codes"))
        in_target = left.column("in_target").to_numpy().astype(np.int64)
        grams, once = np.unique(right.column("gram").to_numpy(), return_index=True)
        t = mean_losses(codes, first, in_target, grams, right.column("t").to_numpy()[once], (history[0], history[2]), word[0])
        b = mean_losses(codes, first, np.ones_like(in_target), grams, right.column("b").to_numpy()[once], (history[1], history[3]), word[1])
        arrays = [pa.array(np.round(x, 9), from_pandas=True) for x in (t, b, t - b)]
        return pa.table([left.column("doc_id").combine_chunks(), pa.array(np.diff(first).astype(np.int64)), *arrays], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    both = flagged.groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
