"""SentencePiece encoding, decoding and sampling of segmentations without replacement.

Sampling sees a text (with the space that SentencePiece puts before it) as a lattice: pieces of the vocabulary are edges
between byte positions, a character that no piece covers is one edge of byte pieces. The model file is a BPE model, whose
scores are negative merge ranks; an edge's weight is the Zipf law of that rank, 1 / (rank + 3). Backward sums over the
lattice give exact probabilities of next pieces, so a text's segmentations form a tree in which every subtree's mass is
known. No piece spans a space but at its start, so sums are kept per distinct word.

Gumbel top-k: the root has a standard Gumbel value, which is the largest perturbed log-probability of all segmentations.
Best-first (A*) search keeps, at each step of each path found, one node for all other branches there, whose value is a
Gumbel truncated at the path's own; the node with the largest value is opened next, and its value passes to one branch.
The paths found are the k largest of all segmentations' perturbed log-probabilities: a sample without replacement. The
value of the next node that is not opened, kappa, gives each sample's inclusion probability 1 - exp(-exp(log p - kappa)).
All random numbers are hashes of the row key, the sample and the position in the text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import blocks, list_array, mix64, run_hashes, segment_sums, text_buffers

SAMPLES = 2
#: Distinct words whose lattices a task remembers before it starts anew.
CACHE_WORDS = 250_000
#: Bytes of text sampled at once; a byte takes some hundred bytes of working arrays.
SAMPLE_BYTES = 1 << 20
#: Bytes or pieces of a word up to which all words of a block are worked on together; what is longer goes on word by word.
LONG_WORD = 2048
#: What the table of pieces says of bytes that are no piece, but that pieces begin with.
BEGINNING = -2
_U = np.uint64
_MULT = _U(0x100000001B3)


@dataclass
class Vocabulary:
    """Pieces as bytes (with spaces for the word mark), weights, byte pieces, and a table from hashes to pieces and their beginnings."""

    pieces: list[bytes]
    weight: np.ndarray
    byte_ids: np.ndarray
    longest: int
    bits: int
    slots: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces, weight, byte_ids = [b""] * n, np.full(n, -np.inf), np.full(256, model.unk_id(), np.int64)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                pieces[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[i] = piece.replace("▁", " ").encode()
                if b" " not in pieces[i][1:]:  # runs of spaces are spelt as single ones
                    weight[i] = -np.log(3 - max(model.get_score(i), -n))  # pieces that no merge makes have the last rank
        use = np.flatnonzero(weight > -np.inf)
        known: dict[int, int] = {}  # hashes of pieces, and of what pieces begin with
        for i in use.tolist():
            h = 0
            for byte in pieces[i]:
                h = (h * int(_MULT) + byte + 1) & 0xFFFFFFFFFFFFFFFF
                known.setdefault(h, BEGINNING)
            known[h] = i
        keys, use = mix64(np.fromiter(known, np.uint64, len(known))), np.fromiter(known.values(), np.int64, len(known))
        bits, slots = 20, []
        while len(use):
            at, first = np.unique(keys >> _U(64 - bits), return_index=True)
            hashes, ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            hashes[at], ids[at] = keys[first], use[first]
            slots.append((hashes, ids))
            left = np.ones(len(use), bool)
            left[first] = False
            use, keys = use[left], keys[left]
        return cls(pieces, weight, byte_ids, max(map(len, pieces)), bits, slots)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, BEGINNING where pieces only begin so, or -1."""
        keys = mix64(hashes)
        at, out = (keys >> _U(64 - self.bits)).astype(np.int64), np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for known, ids in self.slots:
            same = known[at] == keys
            out[left[same]] = ids[at[same]]
            more = ~same & (ids[at] != -1)  # an empty slot has no further keys
            left, at, keys = left[more], at[more], keys[more]
        return out


class Lattices:
    """Lattices of distinct words: nodes are byte positions, edges have a length, a piece (-1: byte pieces) and log q."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.keys, self.base = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # a word's first node
        self.first = np.zeros(1, np.int64)  # a node's first edge
        self.size, self.piece, self.logq, self.prob = np.zeros(0, np.int8), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.float32)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """First node of each word."""
        keys, first, which = np.unique(run_hashes(data, starts, ends, 5), return_index=True, return_inverse=True)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            new = self.keys[at] != keys
        if new.any():
            if len(self.keys) + new.sum() > CACHE_WORDS and len(self.keys):
                self.clear()
                new[:] = True
            self._learn(keys[new], data, starts[first[new]], ends[first[new]])
        return self.base[np.searchsorted(self.keys, keys)][which]

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        v, n = self.vocabulary, ends - starts
        base = np.cumsum(n + 1) - (n + 1)
        unit = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        node, byte, left = base[unit] + inside, data[starts[unit] + inside], n[unit] - inside
        found: list[tuple[np.ndarray, ...]] = []
        live, h = np.flatnonzero((byte & 0xC0) != 0x80), None
        h = np.zeros(len(live), np.uint64)
        width = np.select([byte >= 0xF0, byte >= 0xE0, byte >= 0xC0], [4, 3, 2], 1)
        bare = np.ones(len(byte), bool)  # characters without a piece of their own
        for length in range(1, v.longest + 1):
            keep = left[live] >= length
            live, h = live[keep], h[keep]
            if not len(live):
                break
            h = h * _MULT + byte[live + length - 1].astype(np.uint64) + _U(1)
            piece = v.find(h)
            hit = np.flatnonzero(piece >= 0)
            found.append((live[hit], np.full(len(hit), length, np.int32), piece[hit], v.weight[piece[hit]]))
            bare[live[hit][width[live[hit]] == length]] = False
            begun = piece != -1
            live, h = live[begun], h[begun]
        alone = np.flatnonzero(bare & ((byte & 0xC0) != 0x80))
        found.append((alone, np.minimum(width[alone], left[alone]).astype(np.int32), np.full(len(alone), -1, np.int32), -np.log(2e5) * width[alone]))
        at, size, piece, weight = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at, kind="stable")
        at, size, piece, weight = at[order], size[order], piece[order], weight[order]
        beta = np.zeros(int((n + 1).sum()))
        opened: set[int] = set()
        level = left[at]
        by_level = np.argsort(level.astype(np.uint16) if len(level) and level.max() < 1 << 16 else level, kind="stable")  # short keys are sorted by radix
        level = level[by_level]
        cuts = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1], [True]])) if len(level) else np.zeros(1, int)
        together = int(np.searchsorted(level[cuts[:-1]], LONG_WORD, side="right")) if len(level) else 0
        for a, b in zip(cuts[:together], cuts[1 : together + 1]):
            e = by_level[a:b]
            group = np.flatnonzero(np.concatenate([[True], at[e][1:] != at[e][:-1]]))
            beta[node[at[e[group]]]] = np.logaddexp.reduceat(weight[e] + beta[node[at[e]] + size[e]], group)
        if together < len(cuts) - 1:  # the heads of very long words, from their ends backwards
            e = by_level[cuts[together] :]
            sums = beta.tolist()
            for k, to, w in zip(node[at[e]].tolist(), (node[at[e]] + size[e]).tolist(), weight[e].tolist()):
                more = w + sums[to]
                known = sums[k] if k in opened else -math.inf
                opened.add(k)
                high, low = (known, more) if known > more else (more, known)
                sums[k] = high + math.log1p(math.exp(low - high))
            beta = np.array(sums)
        logq = weight + beta[node[at] + size] - beta[node[at]]
        count = np.bincount(node[at], minlength=int((n + 1).sum()))
        edges, nodes = len(self.size), len(self.first) - 1
        self.first = np.concatenate([self.first, edges + np.cumsum(count)])
        self.size, self.piece, self.logq = np.concatenate([self.size, size.astype(np.int8)]), np.concatenate([self.piece, piece]), np.concatenate([self.logq, logq.astype(np.float32)])
        self.prob = np.concatenate([self.prob, np.exp(logq).astype(np.float32)])
        place = np.searchsorted(self.keys, keys)  # both are sorted
        self.keys, self.base = np.insert(self.keys, place, keys), np.insert(self.base, place, base + nodes)


def uniform(seed: np.ndarray, rows: np.ndarray, sample: int, place: np.ndarray, purpose: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row's seed, the sample, the place in the text and the purpose alone."""
    return fractions(mix64(seed + _U(sample * 16 + purpose))[rows], place)


def fractions(keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The numbers of uniform, from keys that seed, sample and purpose are mixed into."""
    bits = mix64(keys + place.astype(np.uint64))
    return ((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def truncated(mu: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values of location mu, given that they are below top."""
    return mu - np.logaddexp(mu - top, np.log(-np.log(u)))


@dataclass
class Paths:
    """One segmentation per row that has one: edges and the byte positions they start at, row after row."""

    counts: np.ndarray
    edge: np.ndarray
    place: np.ndarray
    other: np.ndarray  # perturbed value of all other branches at each step
    value: np.ndarray  # by row; -inf: no such sample


class Sampler:
    """Samples of the rows of one block."""

    def __init__(self, lattices: Lattices, data: np.ndarray, offs: np.ndarray, seed: np.ndarray):
        self.l, self.seed, self.n, self.samples = lattices, seed, len(offs) - 1, SAMPLES
        lens = np.diff(offs)
        extra = (lens > 0).astype(np.int64)
        self.offs = np.concatenate([[0], np.cumsum(lens + extra)])
        self.data = np.full(int(self.offs[-1]), 0x20, np.uint8)
        self.data[np.arange(len(data)) + np.repeat(np.cumsum(extra), lens)] = data
        self.starts = np.flatnonzero(self.data == 0x20)
        self.ends = np.append(self.starts[1:], len(self.data))
        self.unit_first = np.searchsorted(self.starts, self.offs)
        self.row = np.repeat(np.arange(self.n), np.diff(self.unit_first))
        self.base = lattices.words(self.data, self.starts, self.ends) if len(self.starts) else np.zeros(0, np.int64)

    def _walk(self, units: np.ndarray, skip: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Samples pieces of the given units from `skip` bytes on: pieces of each unit, and per step edge, place and whether it was the only one."""
        size, first, prob = self.l.size, self.l.first, self.l.prob
        at, counts, steps = skip.copy(), np.zeros(len(units), np.int64), []
        live = np.flatnonzero(skip < self.ends[units] - self.starts[units])
        # Of the units that go on: node and place they have come to, their end, their row's first place and key of draws.
        u, row = units[live], self.row[units[live]]
        node, place, end = self.base[u] + skip[live], self.starts[u] + skip[live], self.ends[u]
        origin, key = self.offs[row], mix64(self.seed + _U(sample * 16))[row]
        while len(live) and len(steps) < LONG_WORD:
            begin, last = first[node], first[node + 1] - 1
            edge = begin.copy()
            left = fractions(key, place - origin) - prob[edge]
            more = np.flatnonzero((left > 0) & (edge < last))
            while len(more):
                edge[more] += 1
                left[more] -= prob[edge[more]]
                more = more[(left[more] > 0) & (edge[more] < last[more])]
            steps.append((live, edge, place, last == begin))
            counts[live] += 1
            step = size[edge]
            node, place = node + step, place + step
            go = np.flatnonzero(place < end)
            live, node, place, end, origin, key = live[go], node[go], place[go], end[go], origin[go], key[go]
        at[live] = place - self.starts[units[live]]
        rest = {k: self._walk_on(units[k], int(at[k]), sample) for k in live.tolist()}
        for k, (edges, _) in rest.items():
            counts[k] += len(edges)
        begin = np.cumsum(counts) - counts
        n = int(counts.sum())
        edge, place, alone = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for t, (live, *found) in enumerate(steps):
            for out, x in zip((edge, place, alone), found):
                out[begin[live] + t] = x
        for k, (edges, places) in rest.items():
            own = slice(begin[k] + len(steps), begin[k] + len(steps) + len(edges))
            edge[own], place[own] = edges, places
            node = self.base[units[k]] + places - self.starts[units[k]]
            alone[own] = first[node + 1] - 1 == first[node]
        return counts, edge, place, alone

    def _walk_on(self, unit: int, at: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Samples the rest of one very long word, piece by piece: edges and places."""
        begin, end, base, row = int(self.starts[unit]), int(self.ends[unit]), int(self.base[unit]), int(self.row[unit])
        places = np.arange(begin + at, end)
        draw = uniform(self.seed, np.full(len(places), row), sample, places - self.offs[row], 0).tolist()
        first = self.l.first[base + at : base + end - begin + 1]
        low = int(first[0])
        size, prob = (v[low : first[-1]].tolist() for v in (self.l.size, self.l.prob))
        first = (first - low).tolist()
        edges, taken, k = [], [], 0
        while k < len(places):
            edge, last = first[k], first[k + 1] - 1
            left = draw[k] - prob[edge]
            while left > 0 and edge < last:
                edge += 1
                left -= prob[edge]
            edges.append(edge + low)
            taken.append(k)
            k += size[edge]
        return np.array(edges, np.int64), places[taken]

    def _others(self, path: Paths, sample: int, since: np.ndarray, alone: np.ndarray) -> None:
        """Fills `other` for the steps of each row from its step number `since` on; the rest stays -inf.

        Values are drawn only where they can be among a row's `samples` + 1 largest: a Gumbel of location mu, from 53 random
        bits, lies between mu - log(e^(mu - top) + 37) and mu + 37.
        """
        logq = self.l.logq[path.edge].astype(np.float64)
        row = np.repeat(np.arange(self.n), path.counts)
        first = np.concatenate([[0], np.cumsum(path.counts)])
        total = np.concatenate([[0.0], np.cumsum(logq)])
        path.other = np.full(len(row), -np.inf)
        step = np.arange(len(row)) - first[row]
        at = np.flatnonzero(~alone & (step >= since[row]))
        if not len(at):
            return
        r = row[at]
        with np.errstate(divide="ignore"):
            mu = total[at] - total[first[r]] + np.log(np.maximum(-np.expm1(logq[at]), 1e-12))  # rounding must not close a node that has other branches
        begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        each = np.diff(np.append(begin, len(r)))
        place = np.arange(len(r)) - np.repeat(begin, each)
        head, low = np.flatnonzero(place <= self.samples), np.full(len(r), np.inf)
        low[head] = mu[head] - np.logaddexp(mu[head] - path.value[r[head]], np.log(37.0))
        bound = np.where(each > self.samples, np.minimum.reduceat(low, begin), -np.inf)
        keep = mu + 37 >= np.repeat(bound, each)
        at, r = at[keep], r[keep]
        path.other[at] = truncated(mu[keep], path.value[r], uniform(self.seed, r, sample, path.place[at] - self.offs[r], 1))

    def _nodes(self, place: np.ndarray) -> np.ndarray:
        unit = np.searchsorted(self.starts, place, side="right") - 1
        return self.base[unit] + place - self.starts[unit]

    def run(self, k: int) -> tuple[list[Paths], np.ndarray]:
        """Up to k samples of each row, and kappa."""
        self.samples = k
        zero = np.zeros(self.n, np.int64)
        counts, edge, place, alone = self._walk(np.arange(len(self.starts)), np.zeros(len(self.starts), np.int64), 0)
        per_row = segment_sums(counts, self.unit_first)
        root = -np.log(-np.log(uniform(self.seed, np.arange(self.n), 0, zero, 2)))
        paths = [Paths(per_row, edge, place, edge, root)]
        self._others(paths[0], 0, zero, alone)
        taken: list[list[tuple]] = [[]]  # by path: (rows, step, edge) of branches opened there
        for sample in range(1, k + 1):
            best, parent, step = np.full(self.n, -np.inf), zero.copy(), zero.copy()
            for p, path in enumerate(paths):
                first = np.concatenate([[0], np.cumsum(path.counts)])
                rows = np.flatnonzero(path.counts)
                if len(rows):
                    top = np.maximum.reduceat(path.other, first[rows])
                    hit = np.flatnonzero(path.other == np.repeat(top, path.counts[rows]))
                    owner = np.searchsorted(first, hit, side="right") - 1
                    owner, at = np.unique(owner, return_index=True)
                    better = top > best[rows]
                    best[rows[better]], parent[rows[better]], step[rows[better]] = top[better], p, (hit[at] - first[owner])[better]
            if sample == k:
                return paths, best
            paths.append(self._branch(paths, taken, best, parent, step, sample))
        raise AssertionError

    def _branch(self, paths: list[Paths], taken: list[list[tuple]], value: np.ndarray, parent: np.ndarray, step: np.ndarray, sample: int) -> Paths:
        """Opens the node of other branches at (parent, step) of each row whose value isn't -inf."""
        size, logq, first = self.l.size, self.l.logq, self.l.first
        rows = np.flatnonzero(value > -np.inf)
        prefix_edge, prefix_place, prefix_count = [], [], np.zeros(self.n, np.int64)
        alt_edge, alt_place = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        pieces = []
        for p, path in enumerate(paths):
            own = rows[parent[rows] == p]
            if not len(own):
                continue
            begin = np.concatenate([[0], np.cumsum(path.counts)])
            at = begin[own] + step[own]
            node = self._nodes(path.place[at])
            degree = first[node + 1] - first[node]
            wide = int(degree.max())
            cell = np.minimum(first[node][:, None] + np.arange(wide), first[node + 1][:, None] - 1)
            prob = np.where(np.arange(wide) < degree[:, None], np.exp(logq[cell]), 0.0)
            prob[cell == path.edge[at][:, None]] = 0
            for r, s, e in taken[p]:
                place = np.full(self.n, -1)
                place[r] = np.arange(len(r))
                known = place[own] >= 0
                known[known] &= s[place[own[known]]] == step[own[known]]
                idx = np.flatnonzero(known)
                hit = cell[idx] == e[place[own[idx]]][:, None]
                sub = prob[idx]
                sub[hit] = 0
                prob[idx] = sub
            mass = prob.sum(1)
            draw = uniform(self.seed, own, sample, path.place[at] - self.offs[own], 3) * mass
            pick = np.minimum((np.cumsum(prob, 1) < draw[:, None]).sum(1), wide - 1)
            # Rounding may point at an excluded branch: then the likeliest one is taken.
            pick = np.where(prob[np.arange(len(own)), pick] > 0, pick, prob.argmax(1))
            chosen = cell[np.arange(len(own)), pick]
            alt_edge[own], alt_place[own] = chosen, path.place[at]
            taken[p].append((own, step[own].copy(), chosen))
            # What is left of the node: the other branches but this one, below the value just opened.
            left = np.maximum(mass - prob[np.arange(len(own)), pick], 1e-12)
            more = (prob > 0).sum(1) > 1
            log_before = np.concatenate([[0.0], np.cumsum(logq[path.edge], dtype=np.float64)])
            before = log_before[at] - log_before[begin[own]]
            mu = before + np.log(left)
            again = truncated(mu, value[own], uniform(self.seed, own, sample, path.place[at] - self.offs[own], 4))
            path.other[at] = np.where(more, again, -np.inf)
            pieces.append((own, p))
        taken.append([])
        # The new path: the parent's steps before the branch, the branch, then fresh pieces to the end of the row.
        after = alt_place + size[alt_edge].astype(np.int64) if len(size) else alt_place
        unit = np.searchsorted(self.starts, np.maximum(alt_place, 0), side="right") - 1
        fresh = np.zeros(len(self.starts), bool)
        skip = np.zeros(len(self.starts), np.int64)
        has = np.zeros(self.n, bool)
        has[rows] = True
        index = np.arange(len(self.starts))
        fresh = has[self.row] & (index >= unit[self.row])
        mine = fresh & (index == unit[self.row])
        skip[mine] = (after[self.row] - self.starts)[mine]
        units = np.flatnonzero(fresh)
        counts, edge, place, alone = self._walk(units, skip[units], sample)
        suffix = np.bincount(self.row[units], weights=counts, minlength=self.n).astype(np.int64) if len(units) else np.zeros(self.n, np.int64)
        prefix_count[rows] = step[rows]
        total = np.where(has, prefix_count + 1 + suffix, 0)
        begin = np.cumsum(total) - total
        out_edge, out_place = np.zeros(int(total.sum()), np.int64), np.zeros(int(total.sum()), np.int64)
        for own, p in pieces:
            path = paths[p]
            source = np.cumsum(path.counts) - path.counts
            n = step[own]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, b = np.repeat(begin[own], n) + within, np.repeat(source[own], n) + within
            out_edge[a], out_place[a] = path.edge[b], path.place[b]
        out_edge[begin[rows] + step[rows]], out_place[begin[rows] + step[rows]] = alt_edge[rows], alt_place[rows]
        tail = np.repeat(begin + prefix_count + 1, np.where(has, suffix, 0)) + (np.arange(suffix.sum()) - np.repeat(np.cumsum(suffix) - suffix, suffix))
        out_edge[tail], out_place[tail] = edge, place
        single = np.ones(len(out_edge), bool)
        single[tail] = alone
        new = Paths(total, out_edge, out_place, out_edge, value)
        self._others(new, sample, np.where(has, step + 1, 0), single)
        return new

    def ids(self, path: Paths) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a path, byte pieces spelt out, and how many each row has."""
        piece = self.l.piece[path.edge].astype(np.int64)
        n = np.where(piece < 0, self.l.size[path.edge], 1) if len(piece) else np.zeros(0, np.int64)
        end = np.cumsum(n)
        within = np.arange(end[-1] if len(end) else 0) - np.repeat(end - n, n)
        spelt = self.l.vocabulary.byte_ids[self.data[np.minimum(np.repeat(path.place, n) + within, max(len(self.data) - 1, 0))]] if len(self.data) else within
        ids = np.where(np.repeat(piece, n) < 0, spelt, np.repeat(piece, n))
        return ids, segment_sums(n, np.concatenate([[0], np.cumsum(path.counts)]))


_LOADED: dict[str, Lattices] = {}


def _lattices(path: str) -> Lattices:
    if path not in _LOADED:
        _LOADED[path] = Lattices(Vocabulary.load(path))
    return _LOADED[path]


def _path(model: str | None) -> str:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return model


SAMPLED = "doc_id long, rank int, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean"


def decode_ids(ids: np.ndarray, pieces: list[bytes]) -> bytes:
    """The text of a sequence of ids: the pieces' bytes without the space before the first."""
    return b"".join([pieces[i] for i in ids.tolist()])[1:]


def sample_encodings(docs: DataFrame, samples: int = SAMPLES, seed: int = 0, model: str | None = None) -> DataFrame:
    """Up to `samples` distinct segmentations of each row's whole text: doc_id, rank, ids, log_prob, perturbed,
    log_inclusion, round_trip (whether the ids give back the text).

    A text with fewer segmentations has fewer rows, whose inclusion probability is 1 (log 0) when none is left out. Null
    and empty texts have the one empty segmentation. The seed of a row is its doc_id (null: one fixed value), so repeated
    rows have the same samples. An empty table gives no rows. Only doc_id and text are looked at.
    """
    path = _path(model)

    def run(batches):
        lattices = _lattices(path)
        for block in blocks(batches, limit=SAMPLE_BYTES):
            key = block.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            data, offs = text_buffers(block.column(1))
            s = Sampler(lattices, data, offs, mix64(key + _U(seed)))
            paths, kappa = s.run(samples)
            spell = np.array([len(x) for x in lattices.vocabulary.pieces])
            joined, at = np.frombuffer(b"".join(lattices.vocabulary.pieces), np.uint8), np.cumsum(spell) - spell
            for rank, p in enumerate(paths):
                ids, n = s.ids(p)
                some = np.flatnonzero(p.value > -np.inf)
                logp = segment_sums(lattices.logq[p.edge].astype(np.float64), np.concatenate([[0], np.cumsum(p.counts)]))[some] + 0.0
                with np.errstate(over="ignore", divide="ignore"):
                    z = logp - kappa[some]
                    inclusion = np.where(z < -30, z, np.log(-np.expm1(-np.exp(np.minimum(z, 700)))))
                width = spell[ids]
                text = joined[np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(at[ids], width)]
                bytes_of = segment_sums(width, np.concatenate([[0], np.cumsum(n)]))[some]
                own = np.diff(s.offs)[some]
                whole = bytes_of == own
                if whole.all():  # compare all rows at once
                    place = np.repeat(s.offs[:-1][some], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                    whole &= segment_sums(text != s.data[place], np.concatenate([[0], np.cumsum(own)])) == 0
                else:
                    whole[:] = False
                counts = n[some]
                yield pa.RecordBatch.from_arrays(
                    [block.column(0).take(pa.array(some)), pa.array(np.full(len(some), rank + 1, np.int32)), list_array(ids.astype(np.int32), counts, pa.int32()), *(pa.array(np.round(x, 9)) for x in (logp, p.value[some], inclusion)), pa.array(whole)],
                    names=["doc_id", "rank", "ids", "log_prob", "perturbed", "log_inclusion", "round_trip"],
                )
        lattices.clear()  # the worker process lives on

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, SAMPLED)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and the library's own segmentation of each whole text (null: no ids)."""
    path = _path(model)

    def run(batches):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        for block in blocks(batches):
            ids = processor.encode(["" if t is None else t for t in block.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (null ids: empty text; bytes that are not UTF-8 are replaced)."""
    path = _path(model)

    def run(batches):
        pieces = _lattices(path).vocabulary.pieces
        for b in batches:
            texts = [decode_ids(np.array(x or [], np.int64), pieces).decode(errors="replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        offs, values = np.asarray(b.column(2).offsets), np.asarray(b.column(2).values).astype("<u4")
        crc = [zlib.crc32(values[x:y].tobytes()) for x, y in zip(offs, offs[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64()), *(b.column(k) for k in range(3, 7))], names=["doc_id", "rank", "n_ids", "ids_crc32", "log_prob", "perturbed", "log_inclusion", "round_trip"])


def sample_digests(sampled: DataFrame) -> DataFrame:
    """The samples with n_ids and ids_crc32 in place of the ids."""
    return sampled.mapInArrow(_digest, "doc_id long, rank int, n_ids long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean")
