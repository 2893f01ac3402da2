"""Near-duplicate groups by bottom-k sketches.

1. Each text becomes its set of hashed word shingles; the `k` smallest hashes (one hash function) are its sketch. Texts
   with equal sets form one class, and classes are what follows works on.
2. Inverted lists of retained values generate candidates. Values that more than `list_limit` classes retain (shared
   passages, large families) come last in one order of all values. A class is listed under the first values of its sketch
   in that order: all but as many as a pair shares at least if step 3 keeps it, less one. Two sketches that share so many
   values share one of those, whatever the order, so no pair that step 3 would keep is missed. Lists of rare values are short and give all their
   pairs. Of a frequent value's list, the classes that need it to fill their prefix are compared with the list's most
   typical class, and those that are unlike it with all others, in blocks.
3. The union sketch of a pair (the k smallest of both sketches) estimates its similarity; pairs far below the threshold
   are dropped. What is left joins classes into families, far looser than links.
4. Within families full sets are compared exactly. In a small family all are, in one task. In a large one all are compared
   with its most typical class; what links to it needs no more comparing with its like. The others are compared, in blocks,
   with the classes that their distance from it allows: distances (one less the similarity) obey the triangle inequality.
   Links are intersections of at least `percent` hundredths of the union.
5. Components of the links are groups of near copies.

So a family of f versions of one text costs f comparisons, and what its typical class does not link costs a comparison with
each class of a like distance, which is exact for any family and quadratic only for one without a typical class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ._kernels import LOWER, blocks, list_array, mix64, run_hashes, text_buffers, windows, words
from ._spark import Scratch, discard, staged

SHINGLE = 5
PERCENT = 85
K = 48
LIST_LIMIT = 48
MARGIN = 0.35  # a pair at the threshold is estimated lower than this below it with a chance of 2e-9
BLOCK = 512
_U = np.uint64


def prefix_length(size: int, percent: int) -> int:
    """Values that a sketch of `size` is listed under. A pair that passes the estimate shares at least the fraction percent / 100 - MARGIN of either sketch; two sets that share c values share one of their first size - c + 1, in any one order."""
    return size - max(1, math.ceil((percent / 100 - MARGIN) * size - 1e-9)) + 1 if size else 0


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per row the sorted distinct shingle hashes (63 bits): A-Z lowered; a text of fewer words is one shingle."""
    w = words(LOWER[data], offs)
    hashes = run_hashes(w.data, w.starts, w.ends, 1)
    grams, _, rows = windows(hashes, w.first, width)
    grams >>= _U(1)
    first = np.searchsorted(rows, np.arange(len(offs)))
    for k in range(len(offs) - 1):
        if first[k + 1] > first[k]:
            yield np.unique(grams[first[k] : first[k + 1]])
        else:
            total = np.zeros(1, np.uint64)
            for h in hashes[w.first[k] : w.first[k + 1]]:
                total = mix64(total + h) + _U(width)
            yield (mix64(total) >> _U(1)) if w.first[k + 1] > w.first[k] else np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 63-bit sums that tell sets apart."""
    return int(mix64(s).sum() >> _U(1)), int(mix64(s ^ _U(0x5851F42D4C957F2D)).sum() >> _U(1))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    row = (task.partitionId() if task else 0) << 33
    for block in blocks(batches):
        sets = [*shingle_sets(*text_buffers(block.column(1)))]
        marks = np.array([signature(s) for s in sets], np.int64)
        sketch = [s[:K] for s in sets]
        n = len(sets)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(row, row + n)), block.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), list_array(np.concatenate(sketch).astype(np.int64), np.array([len(s) for s in sketch]), pa.int64())],
            names=["row", "doc_id", "n", "s1", "s2", "sketch"],
        )
        row += n


def _padded(column: pa.Array, fill: int) -> np.ndarray:
    """A list column as a matrix of K columns."""
    offs, values = np.asarray(column.offsets), np.asarray(column.values)
    counts = np.diff(offs)
    out = np.full((len(counts), K), fill, np.int64)
    mask = np.arange(K) < counts[:, None]
    out[mask] = values[offs[0] : offs[-1]]
    return out


def union_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of pairs of sketches (rows padded with the largest integer)."""
    top = np.iinfo(np.int64).max
    both = np.sort(np.concatenate([a, b], 1), 1)
    twin = np.zeros(both.shape, bool)
    twin[:, 1:] = both[:, 1:] == both[:, :-1]
    fresh = ~twin & (both < top)
    inside = np.cumsum(fresh, 1) <= K
    common = (twin & inside & (both < top)).sum(1)
    return common / np.maximum((fresh & inside).sum(1), 1)


def _likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    top = np.iinfo(np.int64).max
    for batch in batches:
        if batch.num_rows:
            keep = union_estimate(_padded(batch.column(2), top), _padded(batch.column(3), top)) >= percent / 100 - MARGIN
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])


def overlaps(every: list[np.ndarray], n: int, both: bool) -> np.ndarray:
    """Common values of the first n sets with each other set if `both`, else with one another (n: all)."""
    values, inverse, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    mask = shared[inverse]
    at, who = number[inverse[mask]], owner[mask]
    common = np.zeros((n, len(every) - n if both else n), np.float32)
    for begin in range(0, int(shared.sum()), 4096):  # dense slices of the shared values
        pick = (at >= begin) & (at < begin + 4096)
        dense = np.zeros((len(every), 4096), np.float32)
        dense[who[pick], at[pick] - begin] = 1
        common += dense[:n] @ (dense[n:] if both else dense).T
    return common


def _forest(hit: np.ndarray, within: bool) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of `hit`: of its rows with one another if `within`, else of rows and columns, which are numbered after the rows."""
    n = len(hit)
    rows = np.ones(n, bool)
    columns = rows if within else np.ones(hit.shape[1], bool)
    out: list[tuple[int, int]] = []
    for first in range(n):
        todo = [first] if rows[first] else []
        rows[first] = False
        while todo:
            x = todo.pop()
            if x < n:
                near = np.flatnonzero(columns & hit[x])
                columns[near] = False
                near = near if within else near + n
            else:
                near = np.flatnonzero(rows & hit[:, x - n])
                rows[near] = False
            todo += near.tolist()
            out += [(x, y) for y in near.tolist()]
    return out


def likely_forest(left: list[np.ndarray], n_left: np.ndarray, right: list[np.ndarray], n_right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a left and a right sketch that share enough for an estimate less MARGIN, and whose sizes (n) allow a link; right ones are numbered after left ones."""
    common = overlaps(left + right, len(left), True)
    held = np.array([len(x) for x in left + right], np.float32)
    least, most = np.minimum(n_left[:, None], n_right), np.maximum(n_left[:, None], n_right)
    hit = (common >= (percent / 100 - MARGIN) * np.minimum(K, held[: len(left), None] + held[len(left) :] - common)) & (100 * least >= percent * most)
    return _forest(hit, False)


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the exact links inside `left`, or between left and right (numbered after left)."""
    every, n = left + (right or []), len(left)
    size = np.array([len(s) for s in every])
    other = size[n:] if right is not None else size
    common = overlaps(every, n, right is not None)
    hit = 100 * common >= percent * (size[:n, None] + other[None] - common)
    return _forest(hit, right is None)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, list_limit: int = LIST_LIMIT, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. Texts without words (null, empty, white space) have n_shingles
    0, are linked with nothing, and are their own component. Repeated rows are in one component and all have kept = true
    if theirs is the smallest doc_id. A null doc_id counts as larger than any other: such a row's component is that of its
    group, or null if the group has no other; kept compares nulls as equal. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch()  # what is deleted when the components are known
    scan = staged(texts.mapInArrow(_scan, "row long, doc_id long, n long, s1 long, s2 long, sketch array<long>"), "sketches")
    key = ["n", "s1", "s2"]
    classes = scratch.staged(scan.filter("n > 0").groupBy(*key).agg(F.min("row").alias("cls"), F.min("doc_id").alias("rep")), "classes")
    nodes = scratch.staged(scan.join(classes.select(F.col("cls").alias("row")), "row").select(F.col("row").alias("cls"), "n", "sketch"), "nodes")

    # Order of values: those in few sketches first, then frequent ones from the rarest up.
    values = nodes.select("cls", F.explode("sketch").alias("v"))
    frequent = scratch.staged(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > list_limit), "frequent")
    small = frequent.count() <= 100_000  # 1.6 MB
    often = F.broadcast(frequent) if small else frequent
    placed = values.join(often, "v", "left").select("cls", F.struct(F.coalesce("df", F.lit(0).cast("long")).alias("df"), "v").alias("x"))
    # How typical a class is of what is frequent: in how many sketches its frequent values are.
    placed = placed.groupBy("cls").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("x.df").alias("typical"))
    lengths = F.array(*(F.lit(prefix_length(size, percent)) for size in range(K + 1)))
    prefix = F.slice("x", F.lit(1), F.get(lengths, F.size("x")))
    chosen = nodes.join(placed.select("cls", prefix.alias("x"), "typical"), "cls")
    of = lambda test: F.transform(F.filter("x", test), lambda y: y["v"])
    ordered = scratch.staged(chosen.select("cls", "n", "sketch", "typical", of(lambda y: y["df"] == 0).alias("rare"), of(lambda y: y["df"] > 0).alias("hot")), "ordered")

    listed = ordered.select("cls", "n", F.explode("rare").alias("v"))
    lists = listed.groupBy("v").agg(F.collect_list(F.struct("n", "cls")).alias("m")).filter(F.size("m") > 1)  # at most list_limit each
    near = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    pairs = lists.select("m", F.explode("m").alias("x"))
    pairs = pairs.select("x", F.explode(F.filter("m", lambda y: (y["cls"] > F.col("x.cls")) & near(y["n"], F.col("x.n")))).alias("y"))
    cold = pairs.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))

    pairs = cold.distinct()
    sketches = ordered.select("cls", "sketch")
    with_a = pairs.join(sketches.withColumnsRenamed({"cls": "a", "sketch": "sa"}), "a")
    with_both = with_a.join(sketches.withColumnsRenamed({"cls": "b", "sketch": "sb"}), "b").select("a", "b", "sa", "sb")
    likely = with_both.mapInArrow(lambda batches: _likely(batches, percent), "a long, b long")
    likely = scratch.staged(likely.unionByName(_hot_pairs(ordered.filter(F.size("hot") > 0), percent, block, scratch)), "likely")

    families = components(likely)
    members = families.join(classes, families["node"] == classes["cls"]).join(ordered.select("cls", "typical"), "cls")
    members = scratch.staged(members.select("cls", F.col("component").alias("family"), "rep", "typical", *key), "members")
    links = scratch.staged(_exact_links(texts, members, percent, block, scratch), "links")
    groups = components(links)
    # The smallest identifier of each component, and back to the rows.
    labelled = classes.join(groups, classes["cls"] == groups["node"], "left").select(*key, "rep", F.coalesce("component", "cls").alias("group"))
    smallest = labelled.groupBy("group").agg(F.min("rep").alias("component_id"))
    labelled = staged(labelled.join(smallest, "group").select(*key, "component_id"), "labelled")
    scratch.discard()
    discard(families, groups)
    out = scan.select("doc_id", *key).join(labelled, key, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _dealt(rows: DataFrame, group: list[str], left: str, block: int) -> DataFrame:
    """Rows for comparing, in each group, the rows where `left` holds with all rows: dealt to pairs of blocks i, j.

    A left row goes with its own block i of left rows to every block j of all rows, and every row goes with its own block j
    to every block i; on_left tells which of both it is for. Groups without left rows vanish.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("all_rows"), F.sum(F.col(left).cast("long")).alias("left_rows")).filter("left_rows > 0")
    parts = sizes.select(*group, F.ceil(F.col("left_rows") / block).cast("int").alias("of_left"), F.ceil(F.col("all_rows") / block).cast("int").alias("of_all"))
    both = rows.join(parts, group)
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = both.filter(left).withColumn("i", own("of_left")).withColumn("j", others("of_all")).withColumn("on_left", F.lit(True))
    rights = both.withColumn("j", own("of_all")).withColumn("i", others("of_left")).withColumn("on_left", F.lit(False))
    return lefts.unionByName(rights).drop("of_left", "of_all")


def _edges(cls: np.ndarray, left: np.ndarray, right: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    """Pairs found between left and right rows, as classes."""
    order = np.concatenate([cls[left], cls[right]])
    pairs = [(int(order[x]), int(order[y])) for x, y in found if order[x] != order[y]]
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _hot_pairs(needy: DataFrame, percent: int, block: int, scratch: Scratch) -> DataFrame:
    """a, b: for each frequent value a spanning set of the likely pairs among all classes whose prefix holds it.

    needy: cls, n, sketch, hot (the frequent values of its prefix), typical.
    """
    asks = needy.select("cls", "n", "sketch", "typical", F.explode("hot").alias("v"))
    pivots = asks.groupBy("v").agg(F.max_by("cls", F.struct("typical", -F.col("cls"))).alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("v", "pivot")
    pivots = pivots.join(needy.select(F.col("cls").alias("pivot"), F.col("n").alias("m"), F.col("sketch").alias("typical_sketch")), "pivot")
    top = np.iinfo(np.int64).max

    def measure(batches):
        for b in batches:
            enough = union_estimate(_padded(b.column(3), top), _padded(b.column(4), top)) >= percent / 100 - MARGIN if b.num_rows else np.zeros(0, bool)
            n, m = (np.asarray(b.column(k)) for k in (5, 6))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(enough & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))], names=["v", "cls", "pivot", "near"])

    pivots = scratch.staged(pivots, "pivots")  # written, so that Spark may split the list of a very frequent value among several tasks
    measured = asks.join(pivots, "v").select("v", "cls", "pivot", "sketch", "typical_sketch", "n", "m").mapInArrow(measure, "v long, cls long, pivot long, near boolean")
    measured = scratch.staged(measured, "measured")
    star = measured.filter("near AND cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b"))

    def compare(table):
        left = table.column("on_left").to_numpy(zero_copy_only=False)
        cls, n, sketch = table.column("cls").to_numpy(), table.column("n").to_numpy(), [np.asarray(x.values) for x in table.column("sketch").combine_chunks()]
        l, r = np.flatnonzero(left), np.flatnonzero(~left)
        if not len(l) or not len(r):
            return _edges(cls, l, r, [])
        return _edges(cls, l, r, likely_forest([sketch[k] for k in l], n[l], [sketch[k] for k in r], n[r], percent))

    dealt = _dealt(measured.select("v", "cls", (~F.col("near")).alias("far")), ["v"], "far", block).join(needy.select("cls", "n", "sketch"), "cls")
    rest = dealt.select("v", "i", "j", "on_left", "cls", "n", "sketch").groupBy("v", "i", "j").applyInArrow(compare, "a long, b long")
    return star.unionByName(rest)


def _shingles(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _exact_links(texts: DataFrame, members: DataFrame, percent: int, block: int, scratch: Scratch) -> DataFrame:
    """a, b: a spanning set of the exact links between the classes of each family."""
    key = ["n", "s1", "s2"]
    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    few = members.count() <= 200_000  # 1.6 MB of identifiers
    chosen = texts.join(F.broadcast(needed) if few else needed, texts["doc_id"].eqNullSafe(needed["doc_id"]), "left_semi")

    def sets(batches):
        for b in blocks(batches):
            own = [*shingle_sets(*text_buffers(b.column(1)))]
            marks = np.array([signature(s) for s in own], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in own], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array([s.tobytes() for s in own], pa.binary())], names=[*key, "shingles"])

    full = chosen.mapInArrow(sets, "n long, s1 long, s2 long, shingles binary").dropDuplicates(key)
    # Written, so that Spark may split a large family among several tasks of the join.
    sizes = scratch.staged(members.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.max_by("cls", F.struct("typical", -F.col("cls"))).alias("pivot")), "families")
    placed = members.join(sizes, "family").select("family", "size", "pivot", "cls", *key)
    placed = scratch.staged(placed.join(full, key).select("family", "size", "pivot", "cls", "shingles"), "full-sets")

    def small(table):
        cls = table.column("cls").to_numpy()
        every = np.arange(len(cls))
        return _edges(cls, every, every[:0], linked(_shingles(table.column("shingles")), None, percent))

    within = placed.filter(F.col("size") <= block).select("family", "cls", "shingles").groupBy("family").applyInArrow(small, "a long, b long")
    large = placed.filter(F.col("size") > block)
    pivots = scratch.staged(large.filter("cls = pivot").select("family", F.col("shingles").alias("typical_set")), "pivots")

    def measure(batches):
        for b in batches:
            own, other = _shingles(b.column(3)), _shingles(b.column(4))
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(own, other)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(own, other)], np.int64) - common
            # The distance in steps a little over that of a link: links reach from one step to the next at most.
            step = np.floor((1 - common / np.maximum(union, 1)) / ((1 - percent / 100) * (1 + 1e-9) + 1e-12)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(100 * common >= percent * union), pa.array(step)], names=["family", "cls", "pivot", "near", "step"])

    measured = large.join(pivots, "family").select("family", "cls", "pivot", "shingles", "typical_set").mapInArrow(measure, "family long, cls long, pivot long, near boolean, step int")
    measured = scratch.staged(measured, "measured")
    star = measured.filter("near AND cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b"))
    # What the typical class does not link, with all classes at its own step and at the two beside it.
    near_steps = F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1))
    asks = measured.filter("NOT near").select("family", near_steps.alias("at"), "cls", F.lit(True).alias("far"))
    told = measured.select("family", F.col("step").alias("at"), "cls", F.lit(False).alias("far"))

    def compare(table):
        left = table.column("on_left").to_numpy(zero_copy_only=False)
        cls, own = table.column("cls").to_numpy(), _shingles(table.column("shingles"))
        l, r = np.flatnonzero(left), np.flatnonzero(~left)
        return _edges(cls, l, r, linked([own[k] for k in l], [own[k] for k in r], percent) if len(l) and len(r) else [])

    dealt = _dealt(asks.unionByName(told), ["family", "at"], "far", block).filter("on_left OR NOT far").join(placed.select("cls", "shingles"), "cls")
    rest = dealt.select("family", "at", "i", "j", "on_left", "cls", "shingles").groupBy("family", "at", "i", "j").applyInArrow(compare, "a long, b long")
    return within.unionByName(star).unionByName(rest)
