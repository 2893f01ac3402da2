"""Listings to canonical records: tags fill unknowns, defaults, replay, and mapping by table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import breed_text, is_mixed, strip, tag_key, tri
from ..model import TAG_RULES

VERSION = 1
#: Fields that tags can fill, and the attribute that holds an explicit value.
TAG_FIELDS = {"kids": "kids_ok", "dogs": "dogs_ok", "cats": "cats_ok", "house_trained": "housetrained"}


def _rule_map(rules: dict[str, tuple[str, str]]) -> Column:
    return F.create_map(*(x for key, (field, value) in rules.items() for x in (F.lit(key), F.lit(f"{field}={value}"))))


def tag_value(tags: Column, field: str, rules: dict[str, tuple[str, str]] = TAG_RULES) -> Column:
    """What the first matching tag says of a field; null if none does."""
    table = _rule_map(rules)
    said = F.filter(F.transform(tags, lambda t: table[tag_key(t)]), lambda r: r.startswith(f"{field}="))
    return F.substring_index(F.get(said, F.lit(0)), "=", -1)


def residual_traits(tags: Column, rules: dict[str, tuple[str, str]] = TAG_RULES) -> Column:
    """Tags that no rule matches, trimmed, in their order."""
    table = _rule_map(rules)
    return F.transform(F.filter(tags, lambda t: table[tag_key(t)].isNull()), strip)


def normalize(listings: DataFrame, rules: dict[str, tuple[str, str]] = TAG_RULES) -> DataFrame:
    """Canonical records of listings, with the version of the rules; a tag never overrides an explicit attribute.

    Missing tags and attributes are empty ones; unknown yes/no/unknown fields are 'unknown', never null.
    """
    c = F.col
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    filled = {f: F.coalesce(c("attributes")[a], tag_value(tags, f, rules), F.lit("unknown")) for f, a in TAG_FIELDS.items()}
    return listings.withColumns({
        "name": strip(c("name")), "raw_breed_text": breed_text(c("breed_primary"), c("breed_secondary")), "is_mixed": is_mixed(c("breed_mixed"), c("breed_primary"), c("breed_secondary")),
        "sex": tri(c("sex")), "size": tri(c("size")), "age_group": tri(c("age")), "age_confidence": F.when(c("age").isNull(), "unknown").otherwise("inferred_from_group"),
        "house_trained": filled["house_trained"], "spayed_neutered": tri(c("attributes")["altered"]), "compat_kids": filled["kids"], "compat_dogs": filled["dogs"], "compat_cats": filled["cats"],
        "traits": residual_traits(tags, rules), "normalizer_version": F.lit(VERSION),
    }).drop("breed_primary", "breed_secondary", "breed_mixed", "age", "attributes", "tags")


def replay(stored: DataFrame, version: int, rules: dict[str, tuple[str, str]] = TAG_RULES) -> DataFrame:
    """Records anew of stored listings (with normalizer_version) that older rules made."""
    old = stored.filter(F.col("normalizer_version") < version).drop("normalizer_version")
    return normalize(old, rules).withColumn("normalizer_version", F.lit(version))


def map_attributes(raw: DataFrame, mappings: DataFrame, fields: list[str], key: str = "pet_id") -> DataFrame:
    """One row per key with the fields that a mapping table finds.

    raw: key, source, attribute, raw_value, position; mappings: source, attribute, raw_value, field, value. Of several
    matches for a field the first by position, then by attribute and value, counts.
    """
    found = raw.join(mappings, ["source", "attribute", "raw_value"])
    first = F.min_by("value", F.struct("position", "attribute", "value"))
    return found.groupBy(key).pivot("field", fields).agg(first)
