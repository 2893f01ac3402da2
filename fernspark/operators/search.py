"""Search over listings: filters, cards, pages, facets, statistics, maps."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import age_label, breed_label, photo_alt
from ..staging import Scratch, staged


@dataclass(frozen=True)
class SearchFilter:
    """What a search asks for; the columns that a table lacks must not be asked for."""

    species: str | None = None
    breed: str | None = None
    age_group: list[str] = field(default_factory=list)
    size: list[str] = field(default_factory=list)
    sex: str | None = None
    energy: list[str] = field(default_factory=list)
    coat: list[str] = field(default_factory=list)
    house_trained: bool | None = None
    good_with: list[str] = field(default_factory=list)
    include_unknown_compat: bool = True
    bbox: tuple[float, float, float, float] | None = None  # min lon, min lat, max lon, max lat
    lat: float | None = None
    lon: float | None = None
    radius: float = 50
    statuses: tuple[str, ...] = ("available",)

    def predicate(self) -> Column:
        terms = [F.col("status").isin(*self.statuses)]
        for name in ("species", "sex"):
            if (value := getattr(self, name)) is not None:
                terms.append(F.col(name) == value)
        for name, column in (("age_group", "age_group"), ("size", "size"), ("energy", "energy_level"), ("coat", "coat_length")):
            if values := getattr(self, name):
                terms.append(F.col(column).isin(*values))
        if self.breed:
            terms.append(F.contains(F.lower("raw_breed_text"), F.lit(self.breed.lower())))
        if self.house_trained is not None:
            terms.append(F.col("house_trained") == str(self.house_trained).lower())
        wanted = ["true", "unknown"] if self.include_unknown_compat else ["true"]
        terms += [F.col(f"compat_{target}").isin(*wanted) for target in self.good_with]
        if self.bbox:
            west, south, east, north = self.bbox
            terms.append(F.col("lat").between(south, north) & F.col("lon").between(west, east))
        if self.lat is not None and self.lon is not None:
            terms.append(geo.within(F.col("lat"), F.col("lon"), self.lat, self.lon, self.radius))
        return reduce(and_, terms)


def miles_from(lat: float | Column, lon: float | Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return geo.haversine_miles(as_column(lat), as_column(lon), F.col("lat"), F.col("lon"))


def first_photo(photos: DataFrame, ties: tuple[str, ...] = ("photo_id",)) -> DataFrame:
    """pet_id, photo_url, photo_blur: of the primary photo with the smallest order; ties by the columns `ties`."""
    order = F.struct(~F.col("is_primary"), "sort_order", *ties)
    first = photos.groupBy("pet_id").agg(F.min_by(F.struct("url", "blur"), order).alias("p"))
    return first.select("pet_id", F.col("p.url").alias("photo_url"), F.col("p.blur").alias("photo_blur"))


def cards(pets: DataFrame, orgs: DataFrame, photos: DataFrame, origin: tuple[float, float] | None = None) -> DataFrame:
    """Card rows. The photos are cut to the pets first, so that a page costs a page's photos.

    Organisations are joined as Spark sizes them: broadcast while they are small.
    """
    org = orgs.select("org_id", "org_name", F.col("state").alias("org_state"), F.col("source").alias("source_label"))
    photo = first_photo(photos.join(pets.select("pet_id"), "pet_id", "left_semi"))
    breed = breed_label(F.col("raw_breed_text"), F.col("is_mixed"))
    distance = geo.half_up(miles_from(*origin), 1) if origin else F.lit(None).cast("double")
    return pets.join(org, "org_id").join(photo, "pet_id", "left").select(
        "pet_id", "name", "species", "age_group", age_label(F.col("age_group")).alias("age_label"), breed.alias("breed_label"), distance.alias("distance_mi"),
        "city", F.col("org_state").alias("state"), "org_name", "source_label", "status", F.col("updated_at").alias("listed_at"), "photo_url", "photo_blur",
        photo_alt(F.col("name"), F.col("age_group"), breed).alias("photo_alt"), "lat", "lon",
    )


#: Sort keys (all ascending or all descending) of each order, the identifier last.
def order_keys(sort: str, origin: tuple[float, float] | None = None) -> tuple[list[Column], bool]:
    if sort == "distance":
        return [miles_from(*origin), F.col("pet_id")], True
    return [F.col("updated_at"), F.col("pet_id")], False


def page(pets: DataFrame, sort: str = "freshness", origin: tuple[float, float] | None = None, after: tuple | None = None, limit: int = 24) -> DataFrame:
    """The rows of one page, `after` a typed cursor (sort value, identifier), and one more if there are more."""
    (value, key), ascending = order_keys(sort, origin)
    if after is not None:
        a, b = (F.lit(x) for x in after)
        pets = pets.filter(((value > a) | ((value == a) & (key > b))) if ascending else ((value < a) | ((value == a) & (key < b))))
    ordered = pets.orderBy(*((c.asc() if ascending else c.desc()) for c in (value, key)))
    return ordered.limit(limit + 1)


def cursor(rows: DataFrame, sort: str = "freshness", origin: tuple[float, float] | None = None, limit: int = 24) -> tuple | None:
    """The cursor of the next page: of the last row of a page that has one more row; None at the end. Fetches one row."""
    (value, key), ascending = order_keys(sort, origin)
    found = rows.orderBy(*((c.asc() if ascending else c.desc()) for c in (value, key))).select(value.alias("v"), key.alias("k")).offset(limit - 1).limit(2).collect()
    return tuple(found[0]) if len(found) == 2 else None


def offset_page(pets: DataFrame, offset: int, limit: int = 24) -> DataFrame:
    return pets.orderBy(F.desc("updated_at"), F.desc("pet_id")).offset(offset).limit(limit)


def facets(pets: DataFrame) -> DataFrame:
    """facet, value, n: counts by species and by age group and the total, in one pass."""
    grouped = pets.groupingSets([["species"], ["age_group"], []], "species", "age_group").agg(F.count(F.lit(1)).alias("n"), F.grouping("species").alias("gs"), F.grouping("age_group").alias("ga"))
    kind = F.when(F.col("gs") == 0, "species").when(F.col("ga") == 0, "age_group").otherwise("total")
    return grouped.select(kind.alias("facet"), F.coalesce("species", "age_group", F.lit("all")).alias("value"), "n")


def zip_origin(searches: DataFrame, zips: DataFrame) -> DataFrame:
    """Searches with the place of their zip; origin_resolved is false where the zip is not known."""
    place = zips.select("zip", F.col("lat").alias("origin_lat"), F.col("lon").alias("origin_lon"))
    return searches.join(place, "zip", "left").withColumn("origin_resolved", F.col("origin_lat").isNotNull())


def hero_stats(pets: DataFrame, photos: DataFrame, newest: int = 48, faces: int = 4) -> DataFrame:
    """total, face_rank, pet_id: the count of pets, and the first faces of the newest ones, those with photos first."""
    recent = pets.orderBy(F.desc("updated_at"), F.desc("pet_id")).limit(newest).select("pet_id", "updated_at")
    photo = first_photo(photos.join(recent, "pet_id", "left_semi"))
    ranked = recent.join(photo, "pet_id", "left").withColumn("face_rank", F.row_number().over(Window.orderBy(F.col("photo_url").isNull(), F.desc("updated_at"), F.desc("pet_id"))))
    total = pets.agg(F.count(F.lit(1)).alias("total"))
    return total.crossJoin(ranked.filter(F.col("face_rank") <= faces).select("face_rank", "pet_id", "photo_url"))  # one row by at most `faces`


def pet_details(pets: DataFrame, orgs: DataFrame, photos: DataFrame, links: DataFrame, ties: tuple[str, ...] = ("photo_id",), link_order: tuple[str, ...] = ("link_id",)) -> DataFrame:
    """Pets with organisation, photos (array of structs in display order, ties by the columns `ties`) and links (array of structs, in `link_order`)."""
    p = photos.select("pet_id", F.struct((~F.col("is_primary")).alias("later"), "sort_order", *ties, "url").alias("x")).groupBy("pet_id").agg(F.array_sort(F.collect_list("x")).alias("photos"))
    k = links.select("pet_id", F.struct(*link_order, "source", "status").alias("x")).groupBy("pet_id").agg(F.array_sort(F.collect_list("x")).alias("links"))
    return pets.join(orgs.select("org_id", "org_name"), "org_id").join(p, "pet_id", "left").join(k, "pet_id", "left")


def known_places(pets: DataFrame) -> DataFrame:
    """Pets with coordinates; (0, 0) stands for unknown ones."""
    return pets.filter("lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)")


def data_bounds(pets: DataFrame) -> DataFrame:
    ends = [f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    return known_places(pets).agg(*ends)


def geo_clusters(pets: DataFrame, zoom: int) -> DataFrame:
    """Clusters of a map at a zoom level: cell, count, centre, and the radius of its circle by count."""
    x, y = geo.mercator_cell(F.col("lat"), F.col("lon"), zoom)
    n = F.col("n")
    cells = known_places(pets).groupBy(x.alias("cell_x"), y.alias("cell_y")).agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return cells.withColumn("circle", _circle(n))


#: Zoom levels that are folded from one staged level.
BAND = 4


def geo_pyramid(pets: DataFrame, top: int = 16) -> DataFrame:
    """Clusters of a map at all zoom levels from 0 to `top`: zoom, cell_x, cell_y, n, lat, lon, circle.

    Pets are read once, for the cells of the top level with their count and sums of coordinates. A cell of a level is four
    of the next, so each band of levels is folded from the cells of the band above, of which there are fewer each time.
    """
    scratch, bands = Scratch(), []
    x, y = geo.mercator_cell(F.col("lat"), F.col("lon"), top)
    sums = [F.sum(c).alias(c) for c in ("n", "lat_sum", "lon_sum")]
    cells = known_places(pets).select(x.alias("cell_x"), y.alias("cell_y"), F.lit(1).alias("n"), F.col("lat").alias("lat_sum"), F.col("lon").alias("lon_sum"))
    cells = scratch.staged(cells.groupBy("cell_x", "cell_y").agg(*sums), "cells")
    bands.append(cells.select(F.lit(top).alias("zoom"), "*"))
    while top > 0:
        steps = min(BAND, top)
        lower = cells.select(F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("down"), "*")
        half = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("down"))).cast("long").alias(c)
        lower = lower.select((F.lit(top) - F.col("down")).alias("zoom"), half("cell_x"), half("cell_y"), "n", "lat_sum", "lon_sum")
        band = scratch.staged(lower.groupBy("zoom", "cell_x", "cell_y").agg(*sums), "cells")
        bands.append(band)
        top -= steps
        cells = band.filter(F.col("zoom") == top).drop("zoom")
    n = F.col("n")
    every = staged(reduce(DataFrame.unionByName, bands), "pyramid")
    scratch.discard()
    return every.select("zoom", "cell_x", "cell_y", "n", (F.col("lat_sum") / n).alias("lat"), (F.col("lon_sum") / n).alias("lon"), _circle(n).alias("circle"))


def _circle(n: Column) -> Column:
    """The radius of a cluster's circle by its count."""
    return F.when(n < 5, 14).when(n < 15, 18).when(n < 50, 24).otherwise(30)


def map_features(pets: DataFrame) -> DataFrame:
    return known_places(pets).select("pet_id", "name", "lon", "lat")
