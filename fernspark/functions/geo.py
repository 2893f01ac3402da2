"""Column builders on places, distances and times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import BORDER, EARTH_MILES


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(a) * F.sin(a) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(b) * F.sin(b)
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * 2 * EARTH_MILES


def half_up(c: Column, digits: int = 0) -> Column:
    return F.floor(c * 10**digits + 0.5) / 10**digits


def degree_box(lat: Column, lon: Column, lat0: float, lon0: float, miles: float) -> Column:
    """A superset of the circle that Parquet can prune on; near poles and the antimeridian longitude is left open."""
    dlat = math.degrees(miles / EARTH_MILES) * 1.0001
    box = lat.between(lat0 - dlat, lat0 + dlat)
    reach = min(89.99, abs(lat0) + dlat)
    ratio = math.sin(miles / EARTH_MILES) / math.cos(math.radians(reach)) if reach < 89.9 else 2
    if ratio < 1:
        dlon = math.degrees(math.asin(ratio)) * 1.0001
        if lon0 - dlon > -180 and lon0 + dlon < 180:
            box &= lon.between(lon0 - dlon, lon0 + dlon)
    return box


def within(lat: Column, lon: Column, lat0: float, lon0: float, miles: float) -> Column:
    return degree_box(lat, lon, lat0, lon0, miles) & (haversine_miles(F.lit(lat0), F.lit(lon0), lat, lon) <= miles)


def coarse_place(lat: Column, lon: Column) -> tuple[Column, Column]:
    """A visitor's place to a hundredth of a degree, about a kilometre, halves up."""
    return half_up(lat, 2), half_up(lon, 2)


def viewport(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The bounds of a map as west,south,east,north with three decimals."""
    return F.concat_ws(",", *(F.format_string("%.3f", x) for x in (west, south, east, north)))


def north_of_border(lat: Column, lon: Column) -> Column:
    """Whether a place lies north of the border line; of two segments that meet the western one counts."""
    out = None
    for (lon1, lat1), (lon2, lat2) in zip(BORDER, BORDER[1:]):
        line = lat1 + (lon - lon1) / (lon2 - lon1) * (lat2 - lat1)
        case = (lon >= lon1) & (lon <= lon2)
        out = F.when(case, lat > line) if out is None else out.when(case, lat > line)
    return F.when((lon < BORDER[0][0]) | (lon > BORDER[-1][0]) | (lat > 84), False).otherwise(out.otherwise(False))


def number_text(c: Column) -> Column:
    """A number with one decimal at most, whole numbers without."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(F.format_string("%.1f", c))


def distance_text(miles: Column, metric: Column) -> Column:
    return F.when(metric, F.concat(half_up(miles * 1.609344).cast("long").cast("string"), F.lit(" km"))).otherwise(F.concat(number_text(miles), F.lit(" mi")))


def radius_text(miles: Column, metric: Column) -> Column:
    """Radii in kilometres are shown to the nearest 5."""
    return F.when(metric, F.concat((half_up(miles * 1.609344 / 5) * 5).cast("long").cast("string"), F.lit(" km"))).otherwise(F.concat(number_text(miles), F.lit(" mi")))


def age_bucket(born: Column, as_of: Column) -> Column:
    """Age group by months of 30.44 days."""
    months = (F.unix_seconds(as_of) - F.unix_seconds(born)) / (30.44 * 86400)
    return F.when(months < 6, "baby").when(months < 24, "young").when(months < 96, "adult").when(months.isNotNull(), "senior")


def elapsed_text(since: Column, as_of: Column) -> Column:
    hours = F.floor((F.unix_seconds(as_of) - F.unix_seconds(since)) / 3600)
    return F.when(hours < 1, "under an hour ago").when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))


def iso_time(c: Column) -> Column:
    """Any readable time as ISO text in UTC; null otherwise."""
    return F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def mercator_cell(lat: Column, lon: Column, zoom: int, pixels: int = 50) -> tuple[Column, Column]:
    """Column and row of a map's grid of `pixels` wide cells at a zoom level (world 512 pixels wide at zoom 0)."""
    world = 512 * 2**zoom / pixels
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    return F.floor((lon + 180) / 360 * world).cast("long"), F.floor((0.5 - y / (2 * math.pi)) * world).cast("long")
