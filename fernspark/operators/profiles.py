"""Saved searches, favourites and profiles, as tables keyed by user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import north_of_border, radius_text
from ..model import NOTES
from .predicates import search_totals

__all__ = ["active_filters", "favourite_states", "fit_notes", "keep_searches", "mark_seen", "new_since_visit", "profile_filters", "search_key", "search_label", "search_totals"]


def new_since_visit(totals: DataFrame) -> DataFrame:
    """new_count: how far the total has risen since it was last seen; null before the first visit."""
    return totals.withColumn("new_count", F.when(F.col("last_seen_total").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("last_seen_total"))))


def mark_seen(totals: DataFrame) -> DataFrame:
    return totals.withColumn("last_seen_total", F.col("total"))


def active_filters(searches: DataFrame) -> Column:
    """How many of breed, size, sex, good_with, house_trained and 'known compatibility only' a search sets."""
    there = [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in ("breed", "size", "sex", "good_with", "house_trained") if c in searches.columns]
    if "include_unknown_compat" in searches.columns:
        there.append(~F.coalesce(F.col("include_unknown_compat"), F.lit(True)))
    return sum((x.cast("int") for x in there), F.lit(0))


def search_key(columns: list[str]) -> Column:
    """Canonical text of a search: its fields that are set, sorted by name, without the cursor."""
    parts = [F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in sorted(columns) if c != "cursor"]
    return F.concat_ws("&", *parts)


def search_label(searches: DataFrame) -> Column:
    """A search in words. Lists are comma-separated text; columns that are missing are fields not set."""
    c = lambda name: F.when(F.col(name).cast("string") != "", F.col(name).cast("string")) if name in searches.columns else F.lit(None).cast("string")
    number = lambda name: c(name).cast("double")
    species = F.when(c("species").isNull(), "All pets").when(c("species") == "other", "Other pets").otherwise(F.concat(F.initcap(c("species")), F.lit("s")))
    slashes = lambda name, sep="/": F.replace(c(name), F.lit(","), F.lit(sep))
    radius = F.when(number("radius").isin(10, 25, 50, 100), number("radius")).otherwise(50.0)
    here = number("lat").isNotNull() & number("lon").isNotNull()
    metric = F.coalesce(north_of_border(number("lat"), number("lon")), F.lit(False))
    near = F.when(c("zip").isNotNull(), F.concat(F.lit("within "), radius.cast("int").cast("string"), F.lit(" mi of "), c("zip"))).when(here, F.concat(F.lit("within "), radius_text(radius, metric), F.lit(" of you")))
    return F.concat_ws(
        " · ", species, F.array_join(F.transform(F.split(c("age_group"), ","), F.initcap), "/"), F.concat(F.lit("size "), F.upper(slashes("size"))), F.concat(slashes("energy"), F.lit(" energy")),
        F.concat(F.lit("good with "), slashes("good_with", " & ")), near, F.when(c("bbox").isNotNull(), "in a map area"),
    )


def keep_searches(searches: DataFrame, most: int = 20) -> DataFrame:
    """Of each user's searches (params, created_at) the first of each params, and of those the newest `most`, newest first (rank)."""
    first = searches.withColumn("_k", F.row_number().over(Window.partitionBy("user_id", "params").orderBy("created_at", "label"))).filter("_k = 1").drop("_k")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "params"))).filter(F.col("rank") <= most)


def favourite_states(favourites: DataFrame, pets: DataFrame) -> DataFrame:
    """Each user's favourites, newest first (rank), with state: active, found a home, not listed."""
    once = favourites.groupBy("user_id", "pet_id").agg(F.max("added_at").alias("added_at"))
    found = once.join(pets.select("pet_id", "name", "status"), "pet_id", "left")
    state = F.when(F.col("status").isNull(), "not listed").when(F.col("status").isin("adopted", "removed"), "found a home").otherwise("active")
    return found.withColumn("state", state).withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("added_at"), F.desc("pet_id"))))


def _answer(profiles: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in profiles.columns else F.lit("")


def profile_filters(profiles: DataFrame) -> DataFrame:
    """Filters that a profile's answers are sure enough for: good_with, size, energy (comma-separated, null if not set)."""
    a = lambda n: _answer(profiles, n)
    good = F.concat_ws(",", F.when(a("kids").isin("little", "big"), "kids"), F.when(a("pets").isin("dogs", "both"), "dogs"), F.when(a("pets").isin("cats", "both"), "cats"))
    return profiles.withColumns({
        "good_with": F.when(good != "", good), "size": F.when(a("home") == "apartment", "xs,s,m"),
        "energy": F.when(a("activity") == "couch", "low,moderate").when(a("activity").isin("adventures", "runs"), "moderate,high,very_high"),
    })


def fit_notes(pairs: DataFrame, most: int = 4) -> Column:
    """Notes on how a pet fits a profile, of pairs with the columns of both, in rule order: array of (tone, text).

    Columns that are missing are answers not given, or unknown facts.
    """
    a = lambda n: _answer(pairs, n)
    fact = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("unknown")) if n in pairs.columns else F.lit("unknown")
    note = lambda pair: F.struct(F.lit(pair[0]).alias("tone"), F.lit(pair[1]).alias("text"))
    lively = fact("energy_level").isin("high", "very_high")
    flat = a("home") == "apartment"
    fits = fact("pet_size").isin("xs", "s", "m") & fact("energy_level").isin("low", "moderate")
    large = (fact("pet_size") == "xl") | (fact("energy_level") == "very_high")

    def about(asked: Column, target: str) -> Column:
        """A note by what is known of a compatibility; anything but true and unknown counts as false."""
        known, said = fact(f"compat_{target}"), NOTES[target]
        return F.when(asked, F.when(known == "true", note(said["true"])).when(known == "unknown", note(said["unknown"])).otherwise(note(said["false"])))

    rules = [
        F.when(flat & fits, note(NOTES["apartment"])).when(flat & large, note(NOTES["space"])), about(a("kids").isin("little", "big"), "kids"), about(a("pets").isin("dogs", "both"), "dogs"), about(a("pets").isin("cats", "both"), "cats"),
        F.when((a("hours") == "over9") & lively, note(NOTES["alone"])), F.when(a("hours") == "under2", note(NOTES["home"])), F.when((a("activity") == "adventures") & lively, note(NOTES["adventure"])),
        F.when((a("experience") == "first_timer") & (fact("special_needs") == "true"), note(NOTES["care"])),
    ]
    return F.slice(F.array_compact(F.array(*rules)), 1, most)
