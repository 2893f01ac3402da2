"""Feeds of listings: payloads to validated listings, and what fails to quarantine.

A feed reader returns one table whose `reasons` column says what is wrong with a row; `split` parts good rows from the
quarantine, which keeps the payload whole. Sources are described by a table: source_id, interval_s, trust, licensed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.hashes import source_kind, source_site
from ..functions.text import blank_null, let, lookup, sex_word, strip, yes_no
from ..model import AGES, PAGE_AGES, PAGE_SIZES, PAGE_SOURCE, PAGE_SPECIES, SEXES, SIZES, SPECIES, STATUSES, WIDGET_AGES, WIDGET_SIZES, WIDGET_SOURCE, WIDGET_SPECIES

#: Pictures that a widget animal has at most.
MAX_PICTURES = 6
SERVICE = "https://service.example/asm"
#: An animal of the widget feed; all fields but ID may be missing.
WIDGET_ANIMAL = (
    "ID bigint, ANIMALNAME string, SPECIESNAME string, BREEDNAME string, BREEDNAME1 string, BREEDNAME2 string, CROSSBREED int, SEXNAME string, SIZENAME string, AGEGROUP string, DATEOFBIRTH string, "
    "ISGOODWITHCHILDRENNAME string, ISGOODWITHCATSNAME string, ISGOODWITHDOGSNAME string, ISHOUSETRAINEDNAME string, NEUTEREDNAME string, WEBSITEMEDIANOTES string, ANIMALCOMMENTS string, "
    "WEBSITEIMAGECOUNT int, RESERVATIONDATE string, SHELTERCODE string, MOSTRECENTENTRYDATE string"
)
_RESOURCE = "struct<id:string,type:string,attributes:variant,relationships:map<string,struct<data:variant>>>"
PAGE = f"struct<data:array<{_RESOURCE}>,included:array<struct<id:string,type:string,attributes:variant>>,meta:struct<pageReturned:int,pages:int>>"


def marked(text: Column, marker: str, end: str, keep: str = "") -> tuple[Column, Column]:
    """What stands between a marker and the next `end` (with the first part of `end` that is to be kept), and the reason if nothing does."""
    at = F.instr(text, marker)
    rest = F.substring(text, at + len(marker), F.length(text))
    stop = F.instr(rest, end)
    reason = F.when(text.isNull() | (at == 0), "payload not found").when(stop == 0, "payload not terminated")
    return F.when(reason.isNull(), F.concat(F.substring(rest, F.lit(1), stop - 1), F.lit(keep))), reason


def parse_widget(payloads: DataFrame) -> DataFrame:
    """account, animal (struct), raw, reason: the animals of widget scripts (columns account, body), one row per animal, or one with a reason.

    raw is an animal's own JSON, with the fields that WIDGET_ANIMAL does not name too, or the whole body where it cannot be read.
    """
    text, reason = marked(F.col("body"), "adoptables = ", "];", "]")
    parsed = payloads.select("account", "body", text.alias("json"), reason.alias("reason")).withColumn("animals", F.from_json("json", f"array<struct<{WIDGET_ANIMAL.replace(' ', ':').replace(',:', ',')}>>"))
    bad = F.coalesce("reason", F.when(F.col("animals").isNull(), "payload unreadable"))
    own = F.transform(F.from_json("json", "array<variant>"), lambda v: F.to_json(v))
    # Named, or it would be parsed anew for each animal.
    both = let(own, lambda own: F.transform("animals", lambda x, k: F.struct(x.alias("animal"), F.coalesce(F.get(own, k), F.to_json(x)).alias("raw"))))
    rows = parsed.withColumn("reason", bad).select("account", F.explode_outer(both).alias("x"), "reason", "body")
    rows = rows.select("account", F.col("x.animal").alias("animal"), F.when(F.col("reason").isNotNull(), F.col("body")).otherwise(F.col("x.raw")).alias("raw"), "reason")
    return rows.filter("animal IS NOT NULL OR reason IS NOT NULL")


def picture_urls(account: Column, animal_id: Column, count: Column) -> Column:
    """Numbered URLs, at most MAX_PICTURES; none for a count of zero, below, or missing."""
    n = F.least(F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)), F.lit(MAX_PICTURES))
    url = lambda i: F.concat(F.lit(f"{SERVICE}?account="), F.url_encode(account), F.lit("&method=animal_image&animalid="), animal_id.cast("string"), F.lit("&seq="), i.cast("string"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), url)).otherwise(F.array().cast("array<string>"))


def with_registry(animals: DataFrame, registry: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Adds org_name (configured, registered, or 'Shelter <account>'), the registered place where both coordinates are known, and suppress_descriptions.

    registry: account, name, city, region, lat, lon, suppress_descriptions; names: account, configured_name.
    """
    known = registry.select("account", F.col("name").alias("_name"), "city", "region", "lat", "lon", "suppress_descriptions")
    out = animals.join(known, "account", "left")
    configured = F.lit(None).cast("string")
    if names is not None:
        out, configured = out.join(names.select("account", "configured_name"), "account", "left"), F.col("configured_name")
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    out = out.withColumn("org_name", F.coalesce(configured, "_name", F.concat(F.lit("Shelter "), "account")))
    out = out.withColumns({c: F.when(placed, F.col(c)) for c in ("city", "region", "lat", "lon")}).withColumn("suppress_descriptions", F.coalesce("suppress_descriptions", F.lit(False)))
    return out.drop("_name", "configured_name")


def widget_listings(animals: DataFrame, as_of: Column) -> DataFrame:
    """Listings of widget animals (as of parse_widget) with registry columns (see with_registry), with their reasons."""
    a = lambda name: F.col(f"animal.{name}")
    crossed = F.coalesce(a("CROSSBREED"), F.lit(0)) != 0
    notes = F.coalesce(blank_null(a("WEBSITEMEDIANOTES")), blank_null(a("ANIMALCOMMENTS")))
    labels = {"kids_ok": "ISGOODWITHCHILDRENNAME", "cats_ok": "ISGOODWITHCATSNAME", "dogs_ok": "ISGOODWITHDOGSNAME", "housetrained": "ISHOUSETRAINEDNAME", "altered": "NEUTEREDNAME"}
    attributes = F.map_filter(F.create_map(*(x for k, v in labels.items() for x in (F.lit(k), yes_no(a(v)).cast("string")))), lambda _, v: v.isNotNull())
    listed = animals.select(
        a("ID").cast("string").alias("external_id"), F.concat(F.lit(f"{WIDGET_SOURCE}:"), "account").alias("source_id"),
        F.concat(F.lit(f"{SERVICE}?account="), F.url_encode("account"), F.lit("&method=animal_view&animalid="), a("ID").cast("string")).alias("url"),
        F.coalesce(blank_null(strip(a("ANIMALNAME"))), F.lit("Unknown")).alias("name"), lookup(a("SPECIESNAME"), WIDGET_SPECIES, "other").alias("species"),
        F.when(crossed, F.coalesce(blank_null(a("BREEDNAME1")), a("BREEDNAME"))).otherwise(a("BREEDNAME")).alias("breed_primary"), F.when(crossed, blank_null(a("BREEDNAME2"))).alias("breed_secondary"), crossed.alias("breed_mixed"),
        F.coalesce(lookup(a("AGEGROUP"), WIDGET_AGES), geo.age_bucket(F.try_to_timestamp(a("DATEOFBIRTH")), as_of)).alias("age"), F.coalesce(sex_word(a("SEXNAME")), F.lit("unknown")).alias("sex"), lookup(a("SIZENAME"), WIDGET_SIZES).alias("size"),
        F.when(~F.col("suppress_descriptions"), blank_null(strip(notes))).alias("description"), picture_urls(F.col("account"), a("ID"), a("WEBSITEIMAGECOUNT")).alias("photos"),
        F.when(blank_null(a("RESERVATIONDATE")).isNotNull(), "pending").otherwise("available").alias("status"), "city", F.col("region").alias("state"), F.lit(None).cast("string").alias("postcode"), "lat", "lon",
        F.col("account").alias("org_external_id"), "org_name", blank_null(a("SHELTERCODE")).alias("org_internal_animal_id"), attributes.alias("attributes"), F.array().cast("array<string>").alias("tags"),
        geo.iso_time(a("MOSTRECENTENTRYDATE")).alias("published_at"), "raw",
    )
    return with_reasons(listed)


def typed(v: Column, path: str, kind: str) -> Column:
    """A field of a variant if it is a string (blank: null), boolean or number; else null."""
    found = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    if kind == "boolean":
        return F.when(found == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
    if kind == "number":
        return F.when(found.isin("BIGINT", "DOUBLE", "FLOAT") | found.startswith("DECIMAL"), F.try_variant_get(v, path, "double"))
    return F.when(found == "STRING", blank_null(F.try_variant_get(v, path, "string")))


def relation(resource: Column, name: str) -> Column:
    """The ids of a relation to one resource or many, as an array."""
    data = resource["relationships"][name]["data"]
    one = F.try_variant_get(data, "$.id", "string")
    return F.coalesce(F.try_variant_get(data, "$", "array<struct<id:string>>")["id"], F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def bucketed(resources: Column, value: Callable[[Column], Column]) -> Column:
    """Resources (id, attributes) of a page in as many buckets of ids as the root of their number, so that a look-up goes through few of them; within a bucket they keep their order.

    Arrays and maps are searched from their start by Spark, which for all pictures of a page takes the square of their number.
    """
    def dealt(held: Column, most: Column) -> Column:
        keyed = F.transform(held, lambda x: F.struct(F.pmod(F.xxhash64(x["id"]), most).alias("bucket"), x["id"].alias("id"), x["value"].alias("value")))
        own = lambda xs, n: let(F.filter(xs, lambda x: x["bucket"] == n), lambda own: F.struct(own["id"].alias("ids"), own["value"].alias("values")))
        return let(keyed, lambda xs: F.transform(F.sequence(F.lit(0).cast("long"), most - 1), lambda n: own(xs, n)))

    held = F.transform(resources, lambda x: F.struct(x["id"].alias("id"), value(x["attributes"]).alias("value")))
    return let(held, lambda xs: let(F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1).cast("long")), lambda most: dealt(xs, most)))


def in_buckets(buckets: Column, key: Column) -> Column:
    """The value of the first resource with an id; null if there is none."""
    own = F.get(buckets, F.pmod(F.xxhash64(key), F.size(buckets)).cast("int"))
    return let(own, lambda x: F.get(x["values"], F.array_position(x["ids"], key).cast("int") - 1))


def page_listings(pages: DataFrame) -> DataFrame:
    """Listings, with their reasons, of JSON:API pages (columns page_id, body): each animal with its first organisation and all pictures in order.

    What an animal points to is looked up in its own page, inside the row; of repeated resources the last counts. A page that
    isn't JSON gives one row with the reason 'payload unreadable'.
    """
    parsed = pages.select("page_id", F.col("body").alias("raw_page"), F.from_json("body", PAGE).alias("p"))
    # The last first, so that it is the one found.
    of = lambda kind: F.reverse(F.filter("p.included", lambda x: x["type"] == kind))
    picture = lambda x: F.coalesce(typed(x, "$.large.url", "string"), typed(x, "$.url", "string"))
    held = parsed.select("raw_page", "p", bucketed(of("pictures"), picture).alias("pictures"), bucketed(of("orgs"), lambda x: x).alias("orgs"))

    def animal(r: Column) -> Column:
        org = F.get(relation(r, "orgs"), F.lit(0))
        photos = F.filter(F.transform(relation(r, "pictures"), lambda k: in_buckets(F.col("pictures"), k)), lambda u: u.isNotNull())
        return F.struct(r.alias("r"), org.alias("org"), in_buckets(F.col("orgs"), org).alias("o"), photos.alias("photos"), F.lit(True).alias("read"), F.lit(None).cast("string").alias("page"))

    none = lambda kind: F.lit(None).cast(kind)
    unread = F.struct(none(_RESOURCE).alias("r"), none("string").alias("org"), none("variant").alias("o"), none("array<string>").alias("photos"), F.lit(False).alias("read"), F.col("raw_page").alias("page"))
    # raw is made after, so that it is left out where nobody asks for it.
    full = held.select(F.explode(F.when(F.col("p.data").isNull(), F.array(unread)).otherwise(F.transform("p.data", animal))).alias("x")).select("x.*")
    full = full.select("*", F.col("r.id").alias("id"), F.col("r.attributes").alias("a"), F.when(F.col("read"), F.to_json("r")).otherwise(F.col("page")).alias("raw"))
    a, o = F.col("a"), F.col("o")
    s, b = (lambda name: typed(a, f"$.{name}", "string")), (lambda name: typed(a, f"$.{name}", "boolean"))
    flags = {"housetrained": "isHousetrained", "altered": "isAltered", "kids_ok": "isKidsOk", "dogs_ok": "isDogsOk", "cats_ok": "isCatsOk"}
    attributes = F.map_filter(F.create_map(*(x for k, v in flags.items() for x in (F.lit(k), b(v).cast("string")))), lambda _, v: v.isNotNull())
    tags = F.from_json(F.to_json(F.try_variant_get(a, "$.qualities", "variant")), "array<variant>")
    tags = F.transform(F.filter(tags, lambda x: F.to_json(x).startswith('"')), lambda x: F.try_variant_get(x, "$", "string"))
    lat, lon = typed(o, "$.lat", "number"), typed(o, "$.lon", "number")
    listed = full.select(
        F.col("id").alias("external_id"), F.lit(PAGE_SOURCE).alias("source_id"), s("url").alias("url"), F.coalesce(s("name"), F.lit("Unknown")).alias("name"), lookup(s("speciesName"), PAGE_SPECIES, "other").alias("species"),
        s("breedPrimary").alias("breed_primary"), s("breedSecondary").alias("breed_secondary"), b("isBreedMixed").alias("breed_mixed"), lookup(s("ageGroup"), PAGE_AGES).alias("age"), F.coalesce(sex_word(s("sex")), F.lit("unknown")).alias("sex"),
        lookup(s("sizeGroup"), PAGE_SIZES).alias("size"), s("descriptionText").alias("description"), F.coalesce("photos", F.array().cast("array<string>")).alias("photos"), F.lit("available").alias("status"),
        typed(o, "$.city", "string").alias("city"), typed(o, "$.state", "string").alias("state"), typed(o, "$.postalcode", "string").alias("postcode"), lat.alias("lat"), lon.alias("lon"), F.col("org").alias("org_external_id"),
        typed(o, "$.name", "string").alias("org_name"), F.coalesce(s("animalID"), s("rescueId")).alias("org_internal_animal_id"), attributes.alias("attributes"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        s("createdDate").alias("published_at"), "raw", "read",
    )
    checked = with_reasons(listed).withColumn("reasons", F.when(F.col("read"), F.col("reasons")).otherwise(F.array(F.lit("payload unreadable"))))
    return checked.select(*(c if c in ("source_id", "raw", "reasons") else F.when(F.col("read"), F.col(c)).alias(c) for c in checked.columns if c != "read"))


def with_reasons(listings: DataFrame) -> DataFrame:
    """listings with `reasons`: the names of the rules that a row breaks, in a fixed order; empty for good rows."""
    c = F.col
    empty = lambda x: x.isNull() | (x == "")
    rules = {
        "missing id": empty(c("external_id")), "missing source": empty(c("source_id")), "missing name": empty(c("name")), "bad url": c("url").isNotNull() & ~c("url").rlike("^[A-Za-z][A-Za-z0-9+.-]*:.+"),
        "bad species": ~F.coalesce(c("species").isin(*SPECIES), F.lit(False)), "bad age": ~c("age").isin(*AGES), "bad sex": ~c("sex").isin(*SEXES), "bad size": ~c("size").isin(*SIZES),
        "bad status": ~F.coalesce(c("status").isin(*STATUSES), F.lit(False)), "bad photo": F.exists("photos", lambda u: ~u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:.+")), "missing organisation": empty(c("org_external_id")),
    }
    return listings.withColumn("reasons", F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items()))))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good listings, and the quarantine: source_id, external_id, reasons, raw."""
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0).select("source_id", "external_id", "reasons", "raw")


def quarantine_report(quarantine: DataFrame) -> DataFrame:
    return quarantine.select("source_id", F.explode("reasons").alias("reason")).groupBy("source_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def split_source(source: Column, licensed: list[str]) -> tuple[Column, Column, Column]:
    """Kind and site of a source id, and whether its kind is licensed for copies of pictures."""
    kind = source_kind(source)
    return kind, source_site(source), kind.isin(*licensed)


def read_widget(spark: SparkSession, path: str, registry: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Good listings and quarantine of landed widget files (JSON lines: account, body)."""
    parsed = parse_widget(spark.read.schema("account string, body string").json(path))
    animals, broken = parsed.filter("reason IS NULL"), parsed.filter("reason IS NOT NULL")
    good, bad = split(widget_listings(with_registry(animals, registry), as_of))
    unread = broken.select(F.concat(F.lit(f"{WIDGET_SOURCE}:"), "account").alias("source_id"), F.lit(None).cast("string").alias("external_id"), F.array("reason").alias("reasons"), "raw")
    return good, bad.unionByName(unread)


def widget_feed(rows: DataFrame, registry: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Good listings, the last of each key, and quarantine of landed widget payloads (source, file, body, error; see sources.landing).

    A source is WIDGET_SOURCE, a colon and the account. Payloads with an error, and bodies that cannot be parsed, go to the
    quarantine whole.
    """
    held = rows.filter("file IS NOT NULL").withColumn("account", F.substring("source", len(WIDGET_SOURCE) + 2, 1 << 30))
    quarantined = lambda df, reason, raw: df.select(F.concat(F.lit(f"{WIDGET_SOURCE}:"), "account").alias("source_id"), F.lit(None).cast("string").alias("external_id"), F.array(reason).alias("reasons"), F.col(raw).alias("raw"))
    parsed = parse_widget(held.filter("error IS NULL"))
    good, bad = split(widget_listings(with_registry(parsed.filter("reason IS NULL"), registry), as_of))
    bad = bad.unionByName(quarantined(parsed.filter("reason IS NOT NULL"), F.col("reason"), "raw")).unionByName(quarantined(held.filter("error IS NOT NULL"), F.col("error"), "body"))
    return latest(good, "raw"), bad


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good listings and quarantine of landed pages (JSON lines: page_id, body)."""
    return split(page_listings(spark.read.schema("page_id string, body string").json(path)))


def source_registry(spark: SparkSession, sources: list[tuple[str, int, int, bool]]) -> DataFrame:
    """The table of sources: source_id, interval_s (between syncs), trust (higher wins), licensed (for copies of pictures)."""
    return spark.createDataFrame(sources, "source_id string, interval_s long, trust int, licensed boolean")


def latest(listings: DataFrame, order: str) -> DataFrame:
    """Of listings that repeat a key in one feed, the last in `order`."""
    w = Window.partitionBy("source_id", "external_id").orderBy(F.desc(order))
    return listings.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
