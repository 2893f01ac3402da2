"""Snapshot files: listings as pets and cards, nested, in JSON; and generated listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import source_kind
from ..functions.text import age_label, breed_label, photo_alt
from ..model import SOURCE_LABELS


def slug(source: Column, external_id: Column) -> Column:
    return F.regexp_replace(F.concat_ws("-", source, external_id), "[^a-zA-Z0-9_-]", "-")


def export(records: DataFrame, as_of: Column) -> DataFrame:
    """pet and card structs of normalised records (see operators.normalize; with source_id, external_id, org columns, published_at)."""
    c = F.col
    id_ = slug(c("source_id"), c("external_id"))
    breed = breed_label(c("raw_breed_text"), c("is_mixed"))
    label = F.coalesce(F.create_map(*(F.lit(x) for pair in SOURCE_LABELS.items() for x in pair))[source_kind(c("source_id"))], c("source_id"))
    now = F.coalesce("published_at", as_of)
    org = F.coalesce("org_name", F.lit("Shelter"))
    photos = F.transform("photos", lambda u, i: F.struct(F.concat(id_, F.lit("-photo-"), i.cast("string")).alias("id"), u.alias("url"), (i == 0).alias("is_primary"), i.alias("sort_order")))
    pet = F.struct(
        id_.alias("id"), "species", "name", "raw_breed_text", "is_mixed", "sex", "size", "age_group", "age_confidence", "house_trained", "spayed_neutered", "compat_kids", "compat_dogs", "compat_cats", "traits", "description", "status",
        F.concat(F.lit("snap-org-"), "org_external_id").alias("organization_id"), org.alias("organization_name"), label.alias("source_label"), "url", F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lon", F.lit(0.0)).alias("lon"),
        "city", "state", photos.alias("photos"), now.alias("updated_at"),
    )
    card = F.struct(
        id_.alias("id"), "name", "species", "age_group", age_label(c("age_group")).alias("age_label"), breed.alias("breed_label"), "city", "state", org.alias("org_name"), label.alias("source_label"), "status", now.alias("listed_at"),
        F.get("photos", F.lit(0)).alias("photo_url"), photo_alt(c("name"), c("age_group"), breed).alias("photo_alt"), "lat", "lon",
    )
    return records.select(pet.alias("pet"), card.alias("card"))


def source_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def write(exported: DataFrame, path: str) -> None:
    """One JSON object per pet; a reader needs no single file."""
    exported.write.json(path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The pets of snapshot files; coordinates (0, 0) are unknown."""
    pets = spark.read.schema(schema).json(path).select("pet.*")
    known = ~((F.col("lat") == 0) & (F.col("lon") == 0))
    return pets.withColumns({k: F.when(known, F.col(k)) for k in ("lat", "lon")})


def generate(seeds: DataFrame, templates: DataFrame, index: str = "i") -> DataFrame:
    """Listings made from templates (t, species, breed, base_lat, base_lon) in turn, one per seed row (index, name), scattered by modular arithmetic."""
    i = F.col(index)
    n = templates.count()
    jitter = lambda k: ((i * k) % 41 - 20) / 200.0
    out = seeds.withColumn("t", i % n).join(templates, "t")
    age = F.element_at(F.array(*map(F.lit, ("baby", "young", "adult", "senior"))), (i % 4 + 1).cast("int"))
    return out.select(
        F.concat(F.lit("demo-gen-"), i.cast("string")).alias("id"), "name", "species", "breed", F.when(i % 2 == 0, "male").otherwise("female").alias("sex"), age.alias("age_group"),
        (F.col("base_lat") + jitter(37)).alias("lat"), (F.col("base_lon") + jitter(53)).alias("lon"), ((i + 6) * 3600).alias("age_s"), (i % 12 + 5).alias("photo_seed"),
    )
