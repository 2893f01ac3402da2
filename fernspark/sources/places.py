"""A table of places in Z-order, and searches by radius that read the files of their region only.

Latitude and longitude are quantised to 16 bits each and interleaved: the first bits of a place's number `z` name a cell of a
quadtree, the number of a cell's places is a range. The table is parted by the first CELL_BITS of z (folders) and sorted by
z within, so that a range of z is a few folders, and a few row groups of their files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import within
from ..model import EARTH_MILES

BITS = 16
#: Leading bits of z that name a folder: 4,096 cells of 5.6 by 2.8 degrees.
CELL_BITS = 12
#: Ranges that a region is spelt out as, about.
RANGES = 64


def _spread(x: Column) -> Column:
    """The low 16 bits of x, with a zero before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def z_order(lat: Column, lon: Column) -> Column:
    """The place's number on the Z curve; null without a place. Latitudes beyond the poles are taken to be there, longitudes wrap."""
    top = (1 << BITS) - 1
    y = F.least(F.lit(top), F.greatest(F.lit(0), F.floor((lat + 90.0) / 180.0 * (1 << BITS)))).cast("long")
    x = F.least(F.lit(top), F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * (1 << BITS))).cast("long")
    return F.shiftleft(_spread(y), 1).bitwiseOR(_spread(x))


def write_places(pets: DataFrame, path: str, files: int | None = None) -> None:
    """Writes pets (lat, lon, ...) with z, by cell. Rows without a place are in the folder of cell -1.

    Files are cut by ranges of (cell, z), so a crowded cell has several. files: about how many; None: as Spark's shuffles have.
    """
    z = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), z_order(F.col("lat"), F.col("lon")))
    placed = pets.withColumn("z", z).withColumn("cell", F.coalesce(F.shiftright("z", 2 * BITS - CELL_BITS), F.lit(-1).cast("long")).cast("int"))
    order = ("cell", "z")
    dealt = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("cell").parquet(path)


def z_ranges(south: float, west: float, north: float, east: float, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of z (ends included), sorted and apart, that together hold a box; about `most` of them. west > east: the box crosses the antimeridian."""
    if west > east:
        return _joined(z_ranges(south, west, north, 180.0, most // 2) + z_ranges(south, -180.0, north, east, most // 2))
    top = (1 << BITS) - 1
    cut = lambda v, low, size: min(top, max(0, math.floor((v - low) / size * (1 << BITS))))
    y0, y1, x0, x1 = cut(south, -90, 180), cut(north, -90, 180), cut(west, -180, 360), cut(east, -180, 360)
    whole: list[tuple[int, int]] = []
    open_cells = [(0, 0, 0, BITS)]  # first z, first y, first x, bits below
    while open_cells and len(whole) + len(open_cells) < most:
        further = []
        for z, y, x, bits in open_cells:
            size = (1 << bits) - 1
            if y > y1 or x > x1 or y + size < y0 or x + size < x0:
                continue
            if y0 <= y and y + size <= y1 and x0 <= x and x + size <= x1:
                whole.append((z, z + (1 << 2 * bits) - 1))
                continue
            half, part = 1 << bits - 1, 1 << 2 * (bits - 1)
            further += [(z + k * part, y + (k >> 1) * half, x + (k & 1) * half, bits - 1) for k in range(4)]
        open_cells = further
    edge = [(z, z + (1 << 2 * bits) - 1) for z, y, x, bits in open_cells if not (y > y1 or x > x1 or y + (1 << bits) - 1 < y0 or x + (1 << bits) - 1 < x0)]
    return _joined(whole + edge)


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def region(lat: float, lon: float, miles: float) -> list[tuple[int, int]]:
    """Ranges of z that hold the circle."""
    dlat = math.degrees(miles / EARTH_MILES) * 1.0001
    reach = abs(lat) + dlat
    ratio = math.sin(miles / EARTH_MILES) / math.cos(math.radians(min(reach, 89.9))) if reach < 89.9 else 2
    if ratio >= 1:
        return z_ranges(lat - dlat, -180.0, lat + dlat, 180.0)
    dlon = math.degrees(math.asin(ratio)) * 1.0001
    wrap = lambda x: (x + 180) % 360 - 180
    return z_ranges(lat - dlat, wrap(lon - dlon), lat + dlat, wrap(lon + dlon))


def near(spark: SparkSession, path: str, lat: float, lon: float, miles: float) -> DataFrame:
    """The places of a table that write_places wrote within `miles` of a place; only folders and row groups that its ranges touch are read."""
    ranges = region(lat, lon, miles)
    cells = sorted({c for low, high in ranges for c in range(low >> 2 * BITS - CELL_BITS, (high >> 2 * BITS - CELL_BITS) + 1)})
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | F.col("z").between(low, high)
    table = spark.read.parquet(path).filter(F.col("cell").isin(cells) & inside)
    return table.filter(within(F.col("lat"), F.col("lon"), lat, lon, miles)).drop("z", "cell")
