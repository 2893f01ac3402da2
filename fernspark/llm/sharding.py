"""Sharding along a Hilbert curve over quantised metadata, in DataFrame operations only.

Dimensions are quantised to 2**bits levels (numbers by approximate quantiles, other values by hash), the cell's index on
the Hilbert curve is the sort key, and runs of equal row counts are cut from that order, so that a shard covers a compact
box in every dimension. The global rank needs no global sort: a row's rank is the number of rows in earlier cells, plus
those in earlier hash ranges of its cell, plus its place in its range. Cells are bounded in number; a cell is dealt into as
many hash ranges of identifiers as its size asks for, so no window holds more than about `rows_per_range` rows, and there
are no more ranges than cells and total rows / `rows_per_range`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import staged

BITS = 4


def hilbert_order(dims: int, bits: int) -> list[int]:
    """For each cell, numbered by its coordinates in base 2**bits, its place on a Hilbert curve through all cells."""
    side = 1 << bits
    out = []
    for cell in range(side**dims):
        x = [(cell // side**k) % side for k in range(dims)]
        step = side >> 1
        while step > 1:  # undo the excess rotations and reflections, from the coarsest level down
            for k in range(dims):
                if x[k] & step:
                    x[0] ^= step - 1
                else:
                    swap = (x[0] ^ x[k]) & (step - 1)
                    x[0] ^= swap
                    x[k] ^= swap
            step >>= 1
        for k in range(1, dims):
            x[k] ^= x[k - 1]
        flip, step = 0, side >> 1
        while step > 1:
            if x[dims - 1] & step:
                flip ^= step - 1
            step >>= 1
        place = 0
        for b in reversed(range(bits)):
            for k in range(dims):
                place = place << 1 | ((x[k] ^ flip) >> b & 1)
        out.append(place)
    return out


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    """The curve index of quantised coordinates (each 0 to 2**bits - 1), by a table of all cells."""
    cell = sum((c * (1 << bits * k) for k, c in enumerate(levels)), F.lit(0))
    return F.element_at(F.lit(hilbert_order(len(levels), bits)), (cell + 1).cast("int"))


def hilbert_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", numeric: tuple[str, ...] = ("__size",), hashed: tuple[str, ...] = ("source", "lang"), bits: int = BITS, rows_per_range: int = 4000) -> DataFrame:
    """docs with __curve, shard (0 to shards - 1) and slot (0 .. within the shard). Row counts of shards differ by one at most.

    Columns of docs named __curve, shard or slot are replaced.

    Nulls in a dimension are a value of their own (level 0 for numbers). Ties on the curve are ordered by the hash of the
    identifier and the identifier; repeated rows are told apart arbitrarily and each gets a slot of its own. With fewer
    rows than shards the first shards hold one row each. An empty table gives an empty result.
    """
    docs = docs.drop("__curve", "shard", "slot")
    levels = [F.pmod(F.xxhash64(F.col(c)), F.lit(1 << bits)).cast("int") for c in hashed]
    stats = docs.agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(c, [k / (1 << bits) for k in range(1, 1 << bits)], 10000).alias(c) for c in numeric)).first()
    for c in numeric:
        levels.append(F.coalesce(sum(((F.col(c) > x).cast("int") for x in stats[c] or []), F.lit(0)), F.lit(0)))
    total = stats["n"]
    running = lambda w: F.sum("__rows").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__rows")
    placed = docs.withColumn("__curve", hilbert_index(levels, bits)).withColumn("__hash", F.xxhash64(F.col(id_col), F.lit("shard order")))
    sizes = placed.groupBy("__curve").agg(F.count(F.lit(1)).alias("__rows"))  # at most 2**(bits * dimensions) rows
    cells = F.broadcast(sizes.select("__curve", F.ceil(F.col("__rows") / rows_per_range).alias("__ranges"), running(Window.orderBy("__curve")).alias("__cell_start")))
    rows = placed.join(cells, "__curve").withColumn("__range", F.pmod(F.col("__hash"), F.col("__ranges")).cast("int"))
    counts = rows.groupBy("__curve", "__range").agg(F.count(F.lit(1)).alias("__rows"), F.first("__cell_start").alias("__cell_start"))
    starts = counts.select("__curve", "__range", (F.col("__cell_start") + running(Window.partitionBy("__curve").orderBy("__range"))).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__curve", "__range").orderBy("__hash", id_col))
    rank = F.col("__start") + F.col("__place") - 1
    # The first `more` shards hold one row more.
    base, more = divmod(total, shards)
    split = more * (base + 1)
    shard = F.when(rank < split, F.floor(rank / (base + 1))).otherwise(more + F.floor((rank - split) / max(base, 1)))
    slot = F.when(rank < split, rank % (base + 1)).otherwise((rank - split) % max(base, 1))
    ranked = rows.withColumn("__place", place).join(starts, ["__curve", "__range"])
    return ranked.select(*(docs[c] for c in docs.columns), "__curve", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, tasks: int | None = None) -> None:
    """One folder per shard, each file a stretch of slots in order, so that file statistics prune on every dimension.

    Stretches are dealt over `tasks` tasks (None: as many as shuffles have), so a shard may be larger than what one task
    takes. Rows without a shard go to a folder of their own; an empty table writes no shard.
    """
    tasks = tasks or int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document (null text: empty, size 16)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", "source", "lang", (F.octet_length(text) + 16).cast("long").alias("__size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = hilbert_shards(staged(slim, "shard-sizes"), shards)  # written, so that texts are read once
    return out.select("doc_id", F.col("__size").alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
