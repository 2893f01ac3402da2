"""Validation of search requests given as a table of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import AGES, COATS, ENERGY, RADII, SEARCH_SPECIES, SIZES

FIELDS = ["species", "breed", "age_group", "size", "sex", "zip", "lat", "lon", "radius", "energy", "house_trained", "coat", "good_with", "include_unknown_compat", "bbox", "sort", "cursor", "limit"]
_NUMBER = "-?\\d+(\\.\\d+)?"


def _lists(c: Column, allowed: list[str], most: int | None = None) -> Column:
    parts = F.split(c, ",")
    bad = ~F.forall(parts, lambda x: x.isin(*allowed))
    return bad | (F.size(parts) > most) if most else bad


def filter_faults(df: DataFrame) -> Column:
    """The names of the fields that are wrong, in a fixed order; columns that df lacks are absent fields."""
    c = lambda name: F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
    number = lambda name: c(name).try_cast("double")
    outside = lambda name, most: number(name).isNull() | ~number(name).between(-most, most)
    rules = {
        "species": ~c("species").isin(*SEARCH_SPECIES), "breed": F.length(c("breed")) > 80, "age_group": _lists(c("age_group"), AGES, 4), "size": _lists(c("size"), SIZES),
        "sex": ~c("sex").isin("male", "female"), "zip": ~c("zip").rlike("^\\d{5}$"), "lat": outside("lat", 90), "lon": outside("lon", 180),
        "radius": number("radius").isNull() | ~number("radius").isin(*map(float, RADII)), "energy": _lists(c("energy"), ENERGY), "house_trained": ~c("house_trained").isin("true", "false"),
        "coat": _lists(c("coat"), COATS), "good_with": _lists(c("good_with"), ["kids", "dogs", "cats"]), "include_unknown_compat": ~c("include_unknown_compat").isin("true", "false"),
        "bbox": ~c("bbox").rlike(f"^{_NUMBER},{_NUMBER},{_NUMBER},{_NUMBER}$"), "sort": ~c("sort").isin("distance", "freshness"), "cursor": F.length(c("cursor")) > 200,
        "limit": number("limit").isNull() | ~number("limit").between(1, 50) | (number("limit") != F.floor(number("limit"))),
    }
    no_place = (c("sort") == "distance") & c("zip").isNull() & (c("lat").isNull() | c("lon").isNull())
    return F.array_compact(F.array(*(F.when(c(k).isNotNull() & rule, k) for k, rule in rules.items()), F.when(no_place, "sort without place")))


def validate_filters(df: DataFrame) -> DataFrame:
    """df with faults and valid, and with the defaults radius 50, sort freshness, limit 24, include_unknown_compat true.

    A request with any fault loses all its fields, and has the defaults alone.
    """
    checked = df.withColumn("faults", filter_faults(df)).withColumn("valid", F.size("faults") == 0)
    defaults = {"radius": "50", "sort": "freshness", "limit": "24", "include_unknown_compat": "true"}
    out = {}
    for name in FIELDS:
        given = F.when(F.col("valid"), F.col(name).cast("string")) if name in df.columns else F.lit(None).cast("string")
        if name in df.columns or name in defaults:
            out[name] = F.coalesce(given, F.lit(defaults.get(name)))
    return checked.withColumns(out)
