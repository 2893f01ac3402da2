"""Many searches at once over one table of pets: an inverted index of the searches' conjuncts.

A search is a conjunction. One with a circle or a box is looked for under the cells that it touches, where searches and pets
meet in tiles of bounded size: what is asked of facts is answered once for each distinct question and distinct facts, and
where it is once for each distinct region and place, so that no row is made for a search and a pet that meet.

A search for a breed anywhere is looked for under the breed texts that contain it, or under its facets, on the table of
distinct facets and breed texts; one for facets alone on that of distinct facets. Equal searches are one.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_miles
from ..model import EARTH_MILES
from ..staging import Scratch, staged

#: Cell sizes in degrees; all divide 360, so that the last cell of a row is as wide as the others.
CELLS = (0.25, 1.0, 4.0, 15.0, 60.0, 360.0)
#: A search takes the smallest cells of which its region is at most so many high and wide.
SPAN = 5
#: Keys (24 bytes) and searches (some 500 bytes) that are broadcast.
FEW_KEYS, FEW_SEARCHES = 500_000, 50_000
LISTS = {"age_group": "age_group", "size": "size", "energy": "energy_level", "coat": "coat_length"}
TARGETS = ("kids", "dogs", "cats")
#: Columns of pets that facets are about.
FACETS = ("species", "sex", "age_group", "size", "energy_level", "coat_length", "house_trained", *(f"compat_{t}" for t in TARGETS))
FIELDS = ("species", "sex", *LISTS, "breed", "house_trained", "good_with", "include_unknown_compat", "west", "south", "east", "north", "lat", "lon", "radius")


def normal_searches(searches: DataFrame) -> DataFrame:
    """search_id and FIELDS: lists as arrays (given as such or comma-separated), texts that are empty and fields that are missing null, the box as four numbers, and a mark that equal searches share."""
    kinds = dict(searches.dtypes)

    def text(name: str) -> Column:
        return F.nullif(F.col(name).cast("string"), F.lit("")) if name in kinds else F.lit(None).cast("string")

    def several(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("array<string>")
        values = F.col(name) if kinds[name].startswith("array") else F.split(F.col(name), ",")
        values = F.array_sort(F.array_distinct(F.filter(values, lambda x: x != "")))
        return F.when(F.size(values) > 0, values)

    number = lambda name: F.col(name).cast("double") if name in kinds else F.lit(None).cast("double")
    box = F.split(text("bbox"), ",")
    edge = lambda k: F.get(box, F.lit(k)).cast("double")
    placed = number("lat").isNotNull() & number("lon").isNotNull()
    here = lambda c: F.when(placed, c)
    flag = F.col("include_unknown_compat").cast("boolean") if "include_unknown_compat" in kinds else F.lit(True)
    given = {
        "species": text("species"), "sex": text("sex"), **{c: several(c) for c in LISTS}, "breed": F.lower(text("breed")), "house_trained": text("house_trained"), "good_with": several("good_with"), "include_unknown_compat": F.coalesce(flag, F.lit(True)),
        "west": edge(0), "south": edge(1), "east": edge(2), "north": edge(3), "lat": here(number("lat")), "lon": here(number("lon")), "radius": here(F.coalesce(number("radius"), F.lit(50.0))),
    }
    out = searches.select("search_id", *(v.alias(k) for k, v in given.items()))
    return out.withColumn("mark", F.sha2(F.to_json(F.struct(*FIELDS)), 256))


def normal_pets(pets: DataFrame) -> DataFrame:
    """The columns of pets that searches look at; those that are missing are unknown."""
    kinds = dict(pets.dtypes)
    named = [(F.col(c).cast("string") if c in kinds else F.lit("unknown")).alias(f"p_{c}") for c in FACETS]
    breed = F.lower("raw_breed_text") if "raw_breed_text" in kinds else F.lit(None).cast("string")
    place = [(F.col(c).cast("double") if c in kinds else F.lit(None).cast("double")).alias(f"p_{c}") for c in ("lat", "lon")]
    return pets.select(*named, breed.alias("p_breed"), *place)


def matches(facets_only: bool = False) -> Column:
    """The whole predicate, of a row of normal_searches and one of normal_pets."""
    c = F.col
    terms = [c(s).isNull() | (c(f"p_{s}") == c(s)) for s in ("species", "sex", "house_trained")]
    terms += [c(s).isNull() | F.array_contains(c(s), c(f"p_{p}")) for s, p in LISTS.items()]
    for target in TARGETS:
        known = c(f"p_compat_{target}")
        terms.append(c("good_with").isNull() | ~F.array_contains("good_with", F.lit(target)) | (known == "true") | ((known == "unknown") & c("include_unknown_compat")))
    if not facets_only:
        terms.append(c("breed").isNull() | F.contains(c("p_breed"), c("breed")))
        terms.append(c("west").isNull() | (c("p_lat").between(c("south"), c("north")) & c("p_lon").between(c("west"), c("east"))))
        terms.append(c("lat").isNull() | (haversine_miles(c("lat"), c("lon"), c("p_lat"), c("p_lon")) <= c("radius")))
    return F.coalesce(reduce(and_, terms), F.lit(False))


def _key(way: str, *parts: Column) -> Column:
    """A hash of a way and what a search and a pet have in common there; that the predicate is verified makes up for equal hashes."""
    return F.xxhash64(F.lit(way), *parts)


def _cell(lat: Column, lon: Column, size: Column) -> tuple[Column, Column]:
    return F.floor(lat / size).cast("int"), F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / size).cast("int")


def place_keys() -> Column:
    """Keys of a search by place: the cells that its circle, or else its box, touches; null without either."""
    c = F.col
    dlat = F.degrees(c("radius") / EARTH_MILES) * 1.0001
    reach = F.abs("lat") + dlat
    ratio = F.sin(c("radius") / EARTH_MILES) / F.cos(F.radians(F.least(reach, F.lit(89.0))))
    dlon = F.when((reach >= 89.0) | (ratio >= 1), 180.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.0001)
    circle = F.struct((c("lat") - dlat).alias("s"), (c("lat") + dlat).alias("n"), (c("lon") - dlon).alias("w"), (c("lon") + dlon).alias("e"))
    box = F.struct(c("south").alias("s"), c("north").alias("n"), c("west").alias("w"), c("east").alias("e"))
    empty = F.array().cast("array<bigint>")

    def spelt(r: Column) -> Column:
        span = F.greatest(r["n"] - r["s"], r["e"] - r["w"])
        size = F.coalesce(*(F.when(span <= SPAN * x, F.lit(x)) for x in CELLS), F.lit(CELLS[-1]))
        low, high = F.floor(r["s"] / size).cast("int"), F.floor(r["n"] / size).cast("int")
        wide = F.ceil(F.lit(360.0) / size).cast("int")
        first, last = F.floor((r["w"] + 180.0) / size).cast("int"), F.floor((r["e"] + 180.0) / size).cast("int")
        columns = F.array_distinct(F.transform(F.sequence(first, F.least(last, first + wide - 1)), lambda x: F.pmod(x, wide)))
        cells = F.flatten(F.transform(F.sequence(low, high), lambda y: F.transform(columns, lambda x: _key("place", size, y, x, F.coalesce(c("species"), F.lit("*"))))))
        return F.when((r["s"] > r["n"]) | (r["w"] > r["e"]) | (span > SPAN * CELLS[-1]), empty).otherwise(cells)

    return F.when(c("lat").isNotNull(), spelt(circle)).when(c("west").isNotNull(), spelt(box))


def facet_key_fields() -> tuple[Column, list[Column]]:
    """Which facets a search fixes to one value (as bits), and those values."""
    single = {"species": F.col("species"), "sex": F.col("sex"), "house_trained": F.col("house_trained"), **{s: F.when(F.size(s) == 1, F.get(s, F.lit(0))) for s in LISTS}}
    bits = sum((F.when(v.isNotNull(), 1 << k).otherwise(0) for k, v in enumerate(single.values())), F.lit(0))
    return bits, list(single.values())


def _facet_columns() -> list[Column]:
    return [F.col(f"p_{x}") for x in ("species", "sex", "house_trained", *LISTS.values())]


def _breed_texts(preds: DataFrame, pets: DataFrame, scratch: Scratch) -> DataFrame:
    """breed, p_breed: the distinct breed texts that contain each breed asked for.

    Both are vocabularies. A text stands under its grams of one to three characters; a breed is looked up under the gram of
    its first characters of that length that the fewest texts have.
    """
    def grams(text: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.array_distinct(F.transform(places, lambda k: F.substring(text, k, F.lit(n))))

    asked = preds.select("breed").filter("breed IS NOT NULL").distinct()
    texts = scratch.staged(pets.select("p_breed").filter("p_breed <> ''").distinct(), "breed-texts")
    under = scratch.staged(texts.select("p_breed", F.explode(F.array_distinct(F.flatten(F.array(*(grams(F.col("p_breed"), n) for n in (1, 2, 3)))))).alias("gram")), "breed-grams")
    size = F.least(F.length("breed"), F.lit(3))
    sought = asked.select("breed", F.explode(F.when(size == 1, grams(F.col("breed"), 1)).when(size == 2, grams(F.col("breed"), 2)).otherwise(grams(F.col("breed"), 3))).alias("gram"))
    counts = under.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    rare = sought.join(counts, "gram").groupBy("breed").agg(F.min_by("gram", F.struct("texts", "gram")).alias("gram"))
    return rare.join(under, "gram").filter(F.contains("p_breed", "breed")).select("breed", "p_breed")


def search_totals(searches: DataFrame, pets: DataFrame) -> DataFrame:
    """searches with total: how many of pets each one finds, by its whole predicate.

    searches: search_id, and any of species, sex, age_group, size, energy, coat, good_with (arrays, or comma-separated),
    breed (contained in the breed text, case aside), house_trained, include_unknown_compat (default: true), bbox
    (west,south,east,north), lat, lon, radius (miles, default 50; without a place it says nothing). Fields that are null or
    empty are not asked for; searches with a zip get its place beforehand (search.zip_origin). pets: those to be counted,
    with any of the columns that searches look at; a missing one is unknown. Null facts match nothing that is asked of them.
    """
    scratch = Scratch()
    normal = scratch.staged(normal_searches(searches), "searches")
    preds = scratch.staged(normal.drop("search_id").dropDuplicates(["mark"]).withColumn("number", F.monotonically_increasing_id()), "predicates")
    named = normal_pets(pets)
    # Pets that are alike in all that is asked are one row with their number; the plan of pets is run once.
    table = scratch.staged(named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n")), "pets")
    nowhere = F.col("lat").isNull() & F.col("west").isNull()
    plain, worded, placed = preds.filter(nowhere & F.col("breed").isNull()), preds.filter(nowhere & F.col("breed").isNotNull()), preds.filter(~nowhere)
    found = _by_facets(plain, table).unionByName(_by_texts(worded, table, scratch)).unionByName(_by_place(placed, table, scratch))
    totals = normal.select("search_id", "mark").join(preds.select("mark", "number"), "mark").join(found, "number", "left")
    totals = staged(totals.select("search_id", F.coalesce("total", F.lit(0).cast("long")).alias("total")), "totals")
    scratch.discard()
    return searches.join(totals.withColumnRenamed("search_id", "_id"), F.col("search_id").eqNullSafe(F.col("_id"))).drop("_id")


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy("number").agg(F.sum("n").alias("total"))


def _set_keys(sets: list[int]) -> list[Column]:
    """A pet's key for each set of facets."""
    return [_key("facets", F.lit(b), *(F.when(F.lit(bool(b >> k & 1)), x) for k, x in enumerate(_facet_columns()))) for b in sets]


def _by_facets(plain: DataFrame, table: DataFrame) -> DataFrame:
    """Searches for facets alone: on distinct facets, each with its number of pets."""
    facets = table.groupBy(*(f"p_{c}" for c in FACETS)).agg(F.sum("n").alias("n"))
    bits, values = facet_key_fields()
    plain = plain.withColumns({"bits": bits, "key": _key("facets", bits, *values)})
    asked = [r["bits"] for r in plain.select("bits").distinct().collect()]  # at most 2**7 rows
    return _summed(facets.withColumn("key", F.explode(F.array(*_set_keys(asked)).cast("array<bigint>"))).join(plain, "key").filter(matches(True)))


def _by_texts(worded: DataFrame, table: DataFrame, scratch: Scratch) -> DataFrame:
    """Searches for a breed, and facets, anywhere: on distinct facets and breed texts, by the way with the fewest of them."""
    told = scratch.staged(table.filter("p_breed <> ''").groupBy("p_breed", *(f"p_{c}" for c in FACETS)).agg(F.sum("n").alias("n")), "told")
    bits, values = facet_key_fields()
    rest = scratch.staged(worded.withColumn("bits", bits), "worded")
    breeds = scratch.staged(_breed_texts(rest, told, scratch), "breeds")
    texts = rest.join(breeds, "breed").select("number", F.lit("breed").alias("way"), _key("breed", F.col("p_breed")).alias("key"))
    fixed = rest.filter("bits > 0").select("number", F.lit("facets").alias("way"), _key("facets", bits, *values).alias("key"))
    keys = scratch.staged(texts.unionByName(fixed), "keys")
    sets = [r["bits"] for r in rest.filter("bits > 0").select("bits").distinct().collect()]  # at most 2**7 rows
    stood = told.withColumn("key", F.explode(F.array(_key("breed", F.col("p_breed")), *_set_keys(sets))))
    weights = stood.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    cost = keys.join(weights, "key", "left").groupBy("number", "way").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    # A search whose breed no text contains finds nothing, whatever its facets; it may be filed under them.
    chosen = cost.groupBy("number").agg(F.min_by("way", F.struct("rows", "way")).alias("way"))
    index = scratch.staged(keys.join(chosen, ["number", "way"]).select("number", "key").join(rest.drop("bits"), "number"), "index")
    terms = matches(True) & F.contains(F.col("p_breed"), F.col("breed"))
    return _summed(stood.join(F.broadcast(index) if index.count() <= FEW_SEARCHES else index, "key").filter(terms))


#: Rows of pets and searches of one cell that meet in one group.
TILE_PETS, TILE_SEARCHES = 16_384, 2_048
#: Rows of a group of tiles, searches times places that are compared at once, and bytes of answers that a task keeps.
GROUP_ROWS, TILE_CELLS, ANSWERS = 400_000, 1 << 20, 1 << 26
#: What a search asks of a pet's facts, and where.
ASKED = ("species", "sex", "house_trained", *LISTS, "good_with", "include_unknown_compat", "breed")
WHERE = ("west", "south", "east", "north", "lat", "lon", "radius")
NOT_GIVEN = 1e300


def _by_place(placed: DataFrame, table: DataFrame, scratch: Scratch) -> DataFrame:
    """Searches with a place: searches and pets of one cell meet in tiles of bounded size, where facts are looked at once for each distinct question and places once for each distinct region."""
    asks = placed.select("number", F.explode(place_keys()).alias("key"), F.to_json(F.struct(*ASKED)).alias("ask"), *WHERE)
    asks = scratch.staged(asks, "asks")
    spots = [_key("place", F.lit(x), *_cell(F.col("p_lat"), F.col("p_lon"), F.lit(x)), s) for x in CELLS for s in (F.col("p_species"), F.lit("*"))]
    facts = F.to_json(F.array(*(f"p_{c}" for c in FACETS), "p_breed"))
    stood = table.filter("p_lat IS NOT NULL AND p_lon IS NOT NULL").select(F.array(*spots).alias("spots"), facts.alias("facts"), F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), "n")
    stood = stood.withColumn("key", F.explode("spots")).drop("spots")
    rows = F.count(F.lit(1))
    wanted = scratch.staged(asks.groupBy("key").agg(rows.alias("asks")), "wanted")
    few = wanted.count() <= FEW_KEYS
    small = lambda df: F.broadcast(df) if few else df
    sizes = stood.join(small(wanted), "key").groupBy("key").agg(F.first("asks").alias("asks"), rows.alias("pets"))
    parts = {"s_parts": F.ceil(F.col("asks") / TILE_SEARCHES).cast("int"), "p_parts": F.ceil(F.col("pets") / TILE_PETS).cast("int")}
    sizes = scratch.staged(sizes.withColumns(parts), "tiles")
    moved = sizes.agg(F.sum(F.col("asks") * F.col("p_parts") + F.col("pets") * F.col("s_parts"))).first()[0] or 0
    groups = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-moved // GROUP_ROWS))
    sizes = sizes.select("key", *parts)
    part = lambda row, n: F.pmod(F.xxhash64(*row), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tile = F.xxhash64("key", "s", "p").alias("tile")
    group = F.pmod(F.xxhash64("key", "s", "p"), F.lit(groups)).alias("group")
    left = asks.join(small(sizes), "key").select("key", part(["number"], "s_parts").alias("s"), each("p_parts").alias("p"), "number", "ask", *WHERE).select(group, tile, "number", "ask", *WHERE)
    right = stood.join(small(sizes), "key").select("key", each("s_parts").alias("s"), part(["facts", "lat", "lon"], "p_parts").alias("p"), "facts", "lat", "lon", "n").select(group, tile, "facts", "lat", "lon", "n")
    return _summed(left.groupBy("group").cogroup(right.groupBy("group")).applyInArrow(_counted, "number long, n long"))


def _counted(asked: pa.Table, pets: pa.Table) -> pa.Table:
    """How many pets each search finds in the tiles of a group; those that find none are left out."""
    if not asked.num_rows or not pets.num_rows:
        return pa.table({"number": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    pets, (ask, questions) = pets.sort_by("tile"), _coded(asked.column("ask"))
    kind, kinds = _coded(pets.column("facts"))
    facts, known = dict(zip((*FACETS, "breed"), zip(*map(json.loads, kinds)))), {}

    def having(column: str, test: str, values: tuple) -> np.ndarray:
        """Which distinct facts have one of some values, or contain a text."""
        if (column, test, values) not in known:
            holds = (lambda v: v in values) if test == "in" else (lambda v: values[0] in v)
            known[column, test, values] = np.array([v is not None and holds(v) for v in facts[column]])
        return known[column, test, values]

    def answer(q: dict) -> np.ndarray:
        """Which distinct facts are what a question asks for."""
        terms = [having(c, "in", (q[c],)) for c in ("species", "sex", "house_trained") if q.get(c) is not None]
        terms += [having(p, "in", tuple(q[c])) for c, p in LISTS.items() if q.get(c) is not None]
        friendly = ("true", "unknown") if q["include_unknown_compat"] else ("true",)
        terms += [having(f"compat_{t}", "in", friendly) for t in TARGETS if t in q.get("good_with", ())]
        terms += [having("breed", "contains", (q["breed"],))] if q.get("breed") is not None else []
        return np.logical_and.reduce(terms) if terms else np.ones(len(kinds), bool)

    tile, lat, lon, weight = (pets.column(c).to_numpy() for c in ("tile", "lat", "lon", "n"))
    where = np.stack([pa.compute.fill_null(asked.column(c), NOT_GIVEN).to_numpy() for c in WHERE])
    at, totals, answers = asked.column("tile").to_numpy(), np.zeros(len(ask), np.int64), {}
    starts = np.flatnonzero(np.diff(tile, prepend=tile[0] - 1))
    ends, tiles = np.append(starts[1:], len(tile)), tile[starts]
    for here in _stretches(np.lexsort((ask, at)), at):
        k = np.searchsorted(tiles, at[here[0]])
        if k == len(tiles) or tiles[k] != at[here[0]]:
            continue
        own = slice(starts[k], ends[k])
        spots, spot = np.unique(lat[own] + 1j * lon[own], return_inverse=True)
        inside = np.concatenate([_inside(where[:, few, None], spots.real, spots.imag) for few in np.array_split(here, -(-len(here) * len(spots) // TILE_CELLS))])
        first = 0
        for rows in _stretches(here, ask):
            q = ask[rows[0]]
            if q not in answers:
                if len(answers) * len(kinds) > ANSWERS:
                    answers.clear()
                answers[q] = answer(json.loads(questions[q]))
            found = answers[q][kind[own]]
            totals[rows] = inside[first : first + len(rows)] @ np.bincount(spot[found], weights=weight[own][found], minlength=len(spots))
            first += len(rows)
    some = np.flatnonzero(totals)
    return pa.table({"number": asked.column("number").take(pa.array(some)), "n": pa.array(totals[some])})


def _stretches(rows: np.ndarray, mark: np.ndarray) -> list[np.ndarray]:
    """rows, cut where their mark changes."""
    return np.split(rows, np.flatnonzero(np.diff(mark[rows])) + 1)


def _coded(texts: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    """Places in the list of distinct texts, and that list."""
    coded = texts.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def _inside(region: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Which places lie in which regions (as of WHERE; NOT_GIVEN where null), as in matches."""
    west, south, east, north, y, x, radius = region
    boxed = (west == NOT_GIVEN) | ((lat >= south) & (lat <= north) & (lon >= west) & (lon <= east))
    a, b = np.radians(lat - y) / 2, np.radians(lon - x) / 2
    h = np.sin(a) * np.sin(a) + np.cos(np.radians(y)) * np.cos(np.radians(lat)) * np.sin(b) * np.sin(b)
    return boxed & ((y == NOT_GIVEN) | (np.arcsin(np.minimum(1.0, np.sqrt(h))) * 2 * EARTH_MILES <= radius))
