"""Substring dedup by collinear chaining of shared seeds.

1. Seeds are hashes of `K` successive words (A-Z lowered), thinned by minimum windows, so that any run of K + WINDOW - 1
   equal words shares a seed wherever it stands.
2. Every seed's first place (smallest doc_id, then position) is its source. Each place of a seed in another document is
   matched with that source alone, so a passage that stands n times gives n matches, not n * n.
3. Matches of a document with one source document merge into segments along diagonals, and segments are chained in both
   texts' order: a Fenwick tree over source positions holds the best chain so far, less a cost for each word of gap.
4. Chains are aligned: the words of both regions are fetched in tiles, matched words counted along segments and in the
   gaps, and both ends extended while they agree. A chain too few of whose words agree is split at its gaps into the
   maximal spans of which enough do.
5. Aligned spans of a document (at least `min_part` words, `identity` of them equal) are united; united spans of at least
   `min_words` words are repeated passages. The first document keeps its passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import LOWER, blocks, list_array, run_hashes, text_buffers, windows, words
from ._spark import staged

K = 6
WINDOW = 8
TILE = 64
MARGIN = 48  # words around a chain that it may grow by
MAX_GAP = 40
GAP_COST = 0.1
MIN_WORDS = 50
MIN_PART = 12
IDENTITY = 0.8
_TOP = np.uint64(2**64 - 1)


def seeds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed hashes, their word positions in the row, and rows; a seed that a row repeats is kept at each of its places."""
    w = words(LOWER[data], offs)
    grams, at, rows = windows(run_hashes(w.data, w.starts, w.ends, 1), w.first, K)
    # Pad each row, so that windows of different rows don't meet; then take minima over windows, and maxima of those.
    counts = np.bincount(rows, minlength=len(offs) - 1) if len(rows) else np.zeros(len(offs) - 1, np.int64)
    shift = np.arange(len(rows)) + rows * WINDOW
    low = np.full(len(rows) + len(counts) * WINDOW + WINDOW, _TOP, np.uint64)
    low[shift] = grams
    mins = low.copy()
    for k in range(1, WINDOW):
        mins[:-k] = np.minimum(mins[:-k], low[k:])
    # A row's windows are those that start and end in it; a shorter row is one window.
    last = np.maximum(np.cumsum(counts) - WINDOW, np.cumsum(counts) - counts)
    mins[shift[np.arange(len(rows)) > last[rows]]] = 0
    valid = np.zeros(len(mins), bool)
    valid[shift] = True
    mins[~valid] = 0
    best = mins.copy()
    for k in range(1, WINDOW):
        best[k:] = np.maximum(best[k:], mins[:-k])
    pick = np.flatnonzero(best[shift] == grams)
    return grams[pick], at[pick] - w.first[rows[pick]], rows[pick]


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        v, at, rows = seeds(*text_buffers(block.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), block.column(0).take(pa.array(rows)), pa.array(at.astype(np.int32))], names=["v", "doc", "pos"])


def best_chains(x: np.ndarray, y: np.ndarray, last: np.ndarray) -> list[list[int]]:
    """Chains of segments: starts (x, y), and words from a segment's start to its last seed. Each segment is in one chain.

    The best chain that ends in a segment is its own length plus the best earlier chain in both coordinates, less
    GAP_COST for each word between them; the earlier chains are kept in a Fenwick tree over y.
    """
    n = len(x)
    if n == 1:
        return [[0]]
    order = np.lexsort((y, x))
    x_end, y_end = x + last, y + last
    ranks = np.sort(np.unique(y_end))
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(ranks) + 1)
    score, before = np.zeros(n), np.full(n, -1)
    waiting = list(np.argsort(x_end, kind="stable"))
    done = 0
    for j in order:
        while done < n and x_end[waiting[done]] < x[j]:
            i = waiting[done]
            value, at = (score[i] + GAP_COST * (x_end[i] + y_end[i]), i), int(np.searchsorted(ranks, y_end[i])) + 1
            while at <= len(ranks):
                if value > tree[at]:
                    tree[at] = value
                at += at & -at
            done += 1
        at, best = int(np.searchsorted(ranks, y[j])), (-np.inf, -1)
        while at:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - GAP_COST * (x[j] + y[j])
        score[j] = last[j] + K
        if gain > 0:
            score[j] += gain
            before[j] = best[1]
    out, used = [], np.zeros(n, bool)
    for j in np.argsort(-score, kind="stable"):
        chain: list[int] = []
        while j >= 0 and not used[j]:
            used[j] = True
            if chain and max(x[chain[-1]] - x_end[j], y[chain[-1]] - y_end[j]) > MAX_GAP + K:
                out.append(chain[::-1])
                chain = []
            chain.append(int(j))
            j = before[j]
        if chain:
            out.append(chain[::-1])
    return out


def _asked(start: np.ndarray, end: np.ndarray, of_pair: np.ndarray, pairs: int) -> pa.ListArray:
    """The tiles that hold the words from MARGIN before each start to MARGIN after each end, once per pair."""
    low, high = np.maximum(start - MARGIN, 0) // TILE, (end + MARGIN) // TILE
    n = high - low + 1
    tile = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    key = np.unique(np.repeat(of_pair, n) << 32 | tile)
    return list_array((key & 0xFFFFFFFF).astype(np.int32), np.bincount(key >> 32, minlength=pairs), pa.int32())


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches sorted by doc, source, diagonal and position: to one row per doc and source, with its chains of segments and the tiles of text around them."""

    def chained(table: pa.Table) -> pa.RecordBatch:
        doc, source, pos, at = (table.column(c).to_numpy() for c in ("doc", "source", "pos", "source_pos"))
        pos, at = pos.astype(np.int64), at.astype(np.int64)
        same = np.zeros(len(doc), bool)
        same[1:] = (doc[1:] == doc[:-1]) & (source[1:] == source[:-1])
        run = same.copy()
        run[1:] &= (pos[1:] - at[1:] == pos[:-1] - at[:-1]) & (pos[1:] - pos[:-1] <= MAX_GAP)
        begin = np.flatnonzero(~run)
        end = np.append(begin[1:], len(doc)) - 1
        pair = np.flatnonzero(~same[begin])
        x, y, last = pos[begin], at[begin], pos[end] - pos[begin]
        order: list[int] = []  # segments in order of pairs and chains
        sizes: list[int] = []  # of chains, in segments
        chains: list[int] = []  # of pairs, in chains
        for a, b in zip(pair, np.append(pair[1:], len(begin))):
            found = best_chains(x[a:b], y[a:b], last[a:b])
            order += [a + k for chain in found for k in chain]
            sizes += map(len, found)
            chains.append(len(found))
        x, y, last = x[order], y[order], last[order] + K
        first = np.cumsum([0, *sizes])
        of_pair = np.repeat(np.arange(len(pair)), chains)
        segments = np.bincount(of_pair, weights=sizes, minlength=len(pair)).astype(np.int64)
        stop = first[1:] - 1
        cols = [pa.array(doc[begin[pair]]), pa.array(source[begin[pair]])]
        cols += [list_array(v.astype(np.int32), segments, pa.int32()) for v in (x, y, last)]
        cols.append(list_array(np.array(sizes, np.int32), np.array(chains), pa.int32()))
        cols += [_asked(v[first[:-1]], v[stop] + last[stop], of_pair, len(pair)) for v in (x, y)]
        return pa.RecordBatch.from_arrays(cols, names=["doc", "source", "xs", "ys", "ls", "sizes", "tiles", "source_tiles"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column(0).to_numpy()
        cut = int(np.searchsorted(doc, doc[-1]))  # the last document may go on in the next batch
        if rows + cut >= 20_000 or rows >= 20_000 and doc[0] != held[-1].column(0)[-1].as_py():
            whole = [*held, batch.slice(0, cut)] if cut else held
            yield chained(pa.Table.from_batches(whole).combine_chunks())
            held, batch = [], batch.slice(cut)
            rows = 0
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield chained(pa.Table.from_batches(held).combine_chunks())


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        data, offs = text_buffers(block.column(1))
        w = words(LOWER[data], offs)
        short = (run_hashes(w.data, w.starts, w.ends, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        each = -(-w.counts // TILE)
        rows = np.repeat(np.arange(len(each)), each)
        tile = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        size = np.minimum(TILE, w.counts[rows] - tile * TILE)
        yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(rows)), pa.array(tile.astype(np.int32)), list_array(short, size, pa.int32())], names=["held", "tile", "words"])


def _extension(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words by which a match extends from the start of a and b, and how many of them agree; a match ends after 3 misses on balance."""
    n = min(len(a), len(b))
    if not n or n > 2 and a[0] != b[0] and a[1] != b[1] and a[2] != b[2]:
        return 0, 0
    equal = a[:n] == b[:n]
    s = np.cumsum(np.where(equal, 1, -2))
    fall = np.flatnonzero(s < np.maximum(np.maximum.accumulate(s), 0) - 5)
    stop = fall[0] if len(fall) else n
    if not stop or s[:stop].max() <= 0:
        return 0, 0
    best = int(np.argmax(s[:stop])) + 1
    return best, int(equal[:best].sum())


def _equal_runs(a: np.ndarray, b: np.ndarray, x: int, y: int) -> list[tuple[int, int, int]]:
    """Maximal runs of equal words of two arrays of one length, as (x, y, words); the arrays start at x and y."""
    edge = np.diff(np.concatenate([[0], (a == b).astype(np.int8), [0]]))
    start = np.flatnonzero(edge == 1)
    return [(x + int(s), y + int(s), int(n)) for s, n in zip(start, np.flatnonzero(edge == -1) - start)]


def _between(a: np.ndarray, b: np.ndarray, x: int, y: int, x_end: int, y_end: int) -> list[tuple[int, int, int]]:
    """Runs of equal words in the gap between two segments: those that go on with either segment, and blocks between them."""
    if x_end <= x or y_end <= y:
        return []
    n = min(x_end - x, y_end - y)
    unlike = np.flatnonzero(a[x : x + n] != b[y : y + n])
    head = int(unlike[0]) if len(unlike) else n
    m = n - head
    unlike = np.flatnonzero(a[x_end - m : x_end][::-1] != b[y_end - m : y_end][::-1])
    tail = int(unlike[0]) if len(unlike) else m
    out = [(x, y, head)] if head else []
    u, v = a[x + head : x_end - tail].tolist(), b[y + head : y_end - tail].tolist()
    if not {*u}.isdisjoint(v):
        out += [(x + head + r.a, y + head + r.b, r.size) for r in SequenceMatcher(None, u, v, autojunk=False).get_matching_blocks() if r.size]
    return out + ([(x_end - tail, y_end - tail, tail)] if tail else [])


def good_spans(runs: list[tuple[int, int, int]], identity: float) -> list[tuple[int, int, int, int, int]]:
    """Maximal spans from a run's start to a run's end of which `identity` is equal: in a, in b, and equal words."""
    if not runs:
        return []
    (x, y, _), (u, v, n), total = runs[0], runs[-1], sum(r[2] for r in runs)
    if total >= identity * max(u + n - x, v + n - y):
        return [(x, u + n, y, v + n, total)]
    x, y, n = np.array(runs, np.int64).T
    x_end, y_end, before = x + n, y + n, np.concatenate([[0], np.cumsum(n)])
    out, best = [], -1
    for i in range(len(n)):
        j = np.arange(max(i, best + 1), len(n))
        fit = np.flatnonzero(before[j + 1] - before[i] >= identity * np.maximum(x_end[j] - x[i], y_end[j] - y[i]))
        if len(fit):
            best = int(j[fit[-1]])
            out.append((int(x[i]), int(x_end[best]), int(y[i]), int(y_end[best]), int(before[best + 1] - before[i])))
        if best == len(n) - 1:
            break
    return out


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, ls: np.ndarray, identity: float = IDENTITY) -> list[tuple[int, int, int, int, int]]:
    """Aligned spans in a and in b, and matched words, for a chain of segments (starts and lengths in a and b).

    A chain is one span if `identity` of its words agree, and otherwise its maximal spans of which that holds. A run of
    equal words around a segment that an overlap with another segment cuts short is a span too.
    """
    back, _ = _extension(a[: xs[0]][::-1], b[: ys[0]][::-1])
    x, y = int(xs[0]) - back, int(ys[0]) - back
    runs, cut = [], False
    at = x, y, x, y  # a diagonal stretch that is not compared yet: its start and end in a and b
    for k, (sx, sy, n) in enumerate(zip(xs.tolist(), ys.tolist(), ls.tolist())):
        if k:
            over = max(at[2] - sx, at[3] - sy, 0)
            cut |= sx <= at[2] or sy <= at[3]
            if over >= n:
                continue
            sx, sy, n = sx + over, sy + over, n - over
            runs += _equal_runs(a[at[0] : at[2]], b[at[1] : at[3]], at[0], at[1])
            runs += _between(a, b, at[2], at[3], sx, sy)
            at = sx, sy, sx, sy
        at = at[0], at[1], sx + n, sy + n
    on, _ = _extension(a[at[2] :], b[at[3] :])
    out = good_spans(runs + _equal_runs(a[at[0] : at[2] + on], b[at[1] : at[3] + on], at[0], at[1]), identity)
    exact = []
    for sx, sy, n in zip(xs.tolist(), ys.tolist(), ls.tolist()) if cut else ():
        low, high = min(sx, sy, MARGIN), n + min(len(a) - sx - n, len(b) - sy - n, MARGIN)
        exact += [r for r in _equal_runs(a[sx - low : sx + high], b[sy - low : sy + high], sx - low, sy - low) if r[2] >= MIN_PART]
    return out + [(x, x + n, y, y + n, n) for x, y, n in dict.fromkeys(exact) if not any(s[0] <= x and x + n <= s[1] for s in out)]


def extensions(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_extension for many matches: rows of word equalities (False beyond a text's end), words to extend by and how many agree."""
    if not equal.shape[1]:
        return np.zeros(len(equal), np.int64), np.zeros(len(equal), np.int64)
    s = np.cumsum(np.where(equal, 1, -2), 1)
    fallen = np.maximum.accumulate(s < np.maximum(np.maximum.accumulate(s, 1), 0) - 5, 1)
    s = np.where(fallen, -9, s)
    best = np.argmax(s, 1)
    good = s[np.arange(len(s)), best] > 0
    words_on = np.where(good, best + 1, 0)
    return words_on, np.where(good, np.cumsum(equal, 1)[np.arange(len(s)), best], 0)


@dataclass
class Stretches:
    """Words of runs of successive tiles: per run the key of its pair, side and first tile, where it starts in `flat`, its first word's place in the text, and its number of words."""

    flat: np.ndarray
    key: np.ndarray
    begin: np.ndarray
    place: np.ndarray
    held: np.ndarray

    def at(self, pair: np.ndarray, side: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words start to end of a pair's text: where its run starts in `flat`, the run's place and number of words, and whether it has all of them."""
        k = np.maximum(np.searchsorted(self.key, (pair * 2 + side) << 32 | start // TILE, side="right") - 1, 0)
        if not len(self.key):
            nothing = np.zeros(len(pair), np.int64)
            return nothing, nothing, nothing, nothing > 0
        fits = (self.key[k] >> 32 == pair * 2 + side) & (self.place[k] <= start) & (end <= self.place[k] + self.held[k])
        return self.begin[k], self.place[k], self.held[k], fits


def _stretches(side: np.ndarray, tile: np.ndarray, pair: np.ndarray, at: np.ndarray, word: np.ndarray) -> Stretches:
    """Of unlike rows under one identifier the tile with the smallest words counts."""
    key = (pair * 2 + side).astype(np.int64) << 32 | tile
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    if same.any():
        order = np.array(sorted(order.tolist(), key=lambda p: (key[p], word[at[p] : at[p + 1]].tolist())))[~same]
    key = key[order]
    size = (at[1:] - at[:-1])[order].astype(np.int64)
    end = np.cumsum(size)
    flat = word[np.arange(end[-1] if len(end) else 0) + np.repeat(at[:-1][order] - (end - size), size)]
    # A tile that is not full is a text's last one.
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1] + 1) | (size[:-1] != TILE)])) if len(key) else np.zeros(0, int)
    held = np.add.reduceat(size, first) if len(first) else size
    return Stretches(flat, key[first], (end - size)[first], (key[first] & 0xFFFFFFFF) * TILE, held)


def _aligned(batches: Iterator[pa.RecordBatch], identity: float) -> Iterator[pa.RecordBatch]:
    """Chains with their tiles: to aligned spans of at least MIN_PART words. Chains of one segment are aligned all at once."""
    for whole in batches:
        for cut in range(0, whole.num_rows, 512):
            batch = whole.slice(cut, 512)
            doc, source = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "source"))
            xs, ys, ls, sizes = (np.asarray(batch.column(k).flatten()).astype(np.int64) for k in ("xs", "ys", "ls", "sizes"))
            chains = np.diff(np.asarray(batch.column("sizes").offsets))
            parts = batch.column("parts")
            inner = parts.flatten()
            words_of = inner.field("words")
            s = _stretches(np.asarray(inner.field("side")), np.asarray(inner.field("tile")).astype(np.int64), np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(parts.offsets))), np.asarray(words_of.offsets).astype(np.int64), np.asarray(words_of.values))
            flat, pair = s.flat, np.repeat(np.arange(batch.num_rows), chains)
            o = np.cumsum([0, *sizes])
            first, last = o[:-1], o[1:] - 1
            # Chains whose seeds come from another row of that identifier reach beyond the words that are there.
            a_begin, a_place, a_held, a_fits = s.at(pair, 0, xs[first], xs[last] + ls[last])
            b_begin, b_place, b_held, b_fits = s.at(pair, 1, ys[first], ys[last] + ls[last])
            fits = a_fits & b_fits
            found: list[np.ndarray] = []  # rows of pair, start, end, source_start, source_end, matched
            singles = np.flatnonzero(fits & (sizes == 1))
            for some in np.array_split(singles, len(singles) // 8192 + 1):
                x, y, size = xs[first[some]], ys[first[some]], ls[first[some]]
                a, b = a_begin[some] + x - a_place[some], b_begin[some] + y - b_place[some]
                before = np.minimum(np.minimum(x - a_place[some], y - b_place[some]), MARGIN)
                after = np.minimum(np.minimum(a_place[some] + a_held[some] - x, b_place[some] + b_held[some] - y) - size, MARGIN)

                def side_equal(start_a, start_b, room, step):
                    reach = np.arange(int(room.max()) if len(room) else 0)
                    inside = reach < room[:, None]
                    go = lambda start: flat[np.where(inside, start[:, None] + step * reach, 0)]
                    return inside & (go(start_a) == go(start_b))

                back, back_equal = extensions(side_equal(a - 1, b - 1, before, -1))
                on, on_equal = extensions(side_equal(a + size, b + size, after, 1))
                end = np.cumsum(size)
                within = np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size)
                middle = np.concatenate([[0], np.cumsum(flat[np.repeat(a, size) + within] == flat[np.repeat(b, size) + within])])
                matched = middle[end] - middle[end - size] + back_equal + on_equal
                length = back + size + on
                sure = matched >= identity * length
                k = np.flatnonzero(sure & (length >= MIN_PART))
                found.append(np.stack([pair[some][k], (x - back)[k], (x + size + on)[k], (y - back)[k], (y + size + on)[k], matched[k]], 1))
                fits[some[sure | (length < MIN_PART)]] = False
            for k in np.flatnonzero(fits).tolist():
                r, a0, b0 = slice(first[k], last[k] + 1), a_place[k], b_place[k]
                skip_a, skip_b = (max(0, v[first[k]] - p - MARGIN) for v, p in ((xs, a0), (ys, b0)))
                mine = flat[a_begin[k] + skip_a : a_begin[k] + min(a_held[k], xs[last[k]] + ls[last[k]] - a0 + MARGIN)]
                other = flat[b_begin[k] + skip_b : b_begin[k] + min(b_held[k], ys[last[k]] + ls[last[k]] - b0 + MARGIN)]
                a0, b0 = a0 + skip_a, b0 + skip_b
                spans = [(pair[k], v[0] + a0, v[1] + a0, v[2] + b0, v[3] + b0, v[4]) for v in align(mine, other, xs[r] - a0, ys[r] - b0, ls[r], identity) if v[1] - v[0] >= MIN_PART]
                found.append(np.array(spans, np.int64).reshape(-1, 6))
            rows = np.concatenate(found)
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            held, n = np.unique(rows[:, 0], return_counts=True)
            spans = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(1, 6)], names=["start", "end", "source_start", "source_end", "matched"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([pa.array(doc[held]), pa.array(source[held]), lists], names=["doc_id", "source_id", "spans"])


#: One row per document and source.
SPANS = "doc_id long, source_id long, spans array<struct<start:long,end:long,source_start:long,source_end:long,matched:long>>"


def repeated_spans(docs: DataFrame, identity: float = IDENTITY) -> DataFrame:
    """Aligned repeats of at least MIN_PART words, `identity` of them equal: doc_id, start, end (words), source_id, source_start, source_end, matched.

    Documents are told apart by doc_id: repeated rows are one document, and rows without doc_id take no part. Null and
    empty texts and texts of fewer than K words have no seeds. An empty table gives no rows.
    """
    each = paired_spans(docs, identity).select("doc_id", "source_id", F.explode("spans").alias("s"))
    return each.select("doc_id", "s.start", "s.end", "source_id", "s.source_start", "s.source_end", "s.matched")


def paired_spans(docs: DataFrame, identity: float = IDENTITY) -> DataFrame:
    """The rows of repeated_spans, with those of one document and one source in an array."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    found = staged(texts.mapInArrow(_seed_rows, "v long, doc long, pos int"), "seeds")
    sources = found.groupBy("v").agg(F.min(F.struct("doc", "pos")).alias("o"), F.max("doc").alias("most")).filter("o.doc < most")
    # Written, so that Spark may split the places of a seed that very many documents hold among several tasks of the join.
    sources = staged(sources.select("v", F.col("o.doc").alias("source"), F.col("o.pos").alias("source_pos")), "sources")
    matches = found.join(sources, "v").filter("doc > source").select("doc", "source", "pos", "source_pos")
    ordered = matches.repartition("doc").sortWithinPartitions("doc", "source", F.col("pos") - F.col("source_pos"), "pos")
    chains = staged(ordered.mapInArrow(_chains, "doc long, source long, xs array<int>, ys array<int>, ls array<int>, sizes array<int>, tiles array<int>, source_tiles array<int>"), "chains")
    ask = lambda text, tiles, side: chains.select("doc", "source", F.lit(side).alias("side"), F.col(text).alias("held"), F.explode(tiles).alias("tile"))
    wanted = ask("doc", "tiles", 0).unionByName(ask("source", "source_tiles", 1))
    some = staged(chains.select("doc").unionByName(chains.select(F.col("source").alias("doc"))).distinct(), "documents")
    few = some.count() <= 200_000  # 1.6 MB of identifiers
    chosen = texts.join(F.broadcast(some) if few else some, texts["doc_id"] == some["doc"], "left_semi")
    tiles = chosen.mapInArrow(_tiles, "held long, tile int, words array<int>")
    got = wanted.join(tiles, ["held", "tile"]).groupBy("doc", "source").agg(F.collect_set(F.struct("side", "tile", "words")).alias("parts"))
    return chains.drop("tiles", "source_tiles").join(got, ["doc", "source"]).mapInArrow(lambda batches: _aligned(batches, identity), SPANS)


def _unions(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Of each document's spans (sorted by start) the maximal unions that are long enough."""
    low = (1 << 40) - 1
    for batch in batches:
        spans = batch.column(1).flatten()
        start, end, source = (np.asarray(spans.field(k)) for k in range(3))
        if not len(start):
            continue
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column(1).offsets)))
        reach = np.maximum.accumulate(row << 40 | end)  # the furthest end so far, anew in each row
        fresh = np.ones(len(start), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (start[1:] > (reach[:-1] & low))
        first = np.flatnonzero(fresh)
        stop = reach[np.append(first[1:], len(start)) - 1] & low
        keep = stop - start[first] >= min_words
        union = np.cumsum(fresh) - 1
        some = np.lexsort((source, union))
        once = np.ones(len(some), bool)
        once[1:] = (union[some][1:] != union[some][:-1]) | (source[some][1:] != source[some][:-1])
        some = some[once]
        some = some[keep[union[some]]]
        sources = list_array(source[some], np.bincount(union[some], minlength=len(first))[keep], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first[keep]])), pa.array(start[first[keep]]), pa.array(stop[keep]), sources], names=["doc_id", "start", "end", "sources"])


def united(pairs: DataFrame, min_words: int = MIN_WORDS, min_part: int = MIN_PART, identity: float = IDENTITY) -> DataFrame:
    """doc_id, start, end, sources: maximal unions (overlapping or adjoining) of good enough spans (as paired_spans gives them), of at least min_words words."""
    long_enough = lambda s: s["end"] - s["start"] >= min_part
    alike = lambda s: s["matched"] >= identity * F.greatest(s["end"] - s["start"], s["source_end"] - s["source_start"])
    good = F.transform(F.filter("spans", lambda s: long_enough(s) & alike(s)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.col("source_id").alias("source_id")))
    each = pairs.select("doc_id", good.alias("s")).groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("s"))
    return each.mapInArrow(lambda batches: _unions(batches, min_words), "doc_id long, start long, end long, sources array<long>")


def cut_spans(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with the passages' words (and the white space after them) taken out of text; n_chars, if there, is counted anew.

    Documents of which no word is left are dropped; documents without passages stay as they are, empty ones too. Spans
    beyond a row's words (of another row under the same identifier) are cut off at its end.
    """
    names = docs.columns
    cuts = staged(passages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts")).withColumnRenamed("doc_id", "__doc"), "cuts")
    few = cuts.count() <= 50_000
    marked = docs.join(F.broadcast(cuts) if few else cuts, docs["doc_id"] == cuts["__doc"], "left").drop("__doc")
    text, at = names.index("text"), len(names)

    def run(batches):
        for b in blocks(batches):
            spans = b.column(at).to_pylist()
            hit = [k for k, s in enumerate(spans) if s]
            columns = list(b.columns[:at])
            if hit:
                texts = b.column(text).to_pylist()
                hit = [k for k in hit if texts[k] is not None]
                for k in hit:
                    raw = texts[k].encode()
                    w = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    keep, done = [], 0
                    for s in spans[k]:
                        if s["start"] >= len(w.starts):
                            break
                        keep.append(raw[done : w.starts[s["start"]]])
                        done = w.starts[s["end"]] if s["end"] < len(w.starts) else len(raw)
                    texts[k] = b"".join([*keep, raw[done:]]).decode()
                columns[text] = pa.array(texts, b.schema.field(text).type)
                if "n_chars" in names:
                    n = b.column(names.index("n_chars")).to_pylist()
                    for k in hit:
                        n[k] = len(texts[k])
                    columns[names.index("n_chars")] = pa.array(n, b.schema.field(names.index("n_chars")).type)
                gone = {k for k in hit if not texts[k].strip(" \t\n\v\f\r")}
                stay = pa.array([k not in gone for k in range(b.num_rows)])
                columns = [c.filter(stay) for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.mapInArrow(run, docs.schema)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end (words), sources: passages of a document that earlier documents (smaller doc_id) hold too."""
    return united(paired_spans(docs), min_words)
