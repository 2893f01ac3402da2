"""Domain views over the driver tables, as SQL that Spark and DuckDB read alike, and the tables they stand on."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels")

VIEWS = {
    "orgs": """
SELECT s_suppkey AS org_id, s_name AS org_name, concat('S', s_nationkey) AS state,
  CAST(25.0 AS DOUBLE) + ((s_suppkey*53) % (2300))/CAST(100.0 AS DOUBLE) AS lat, -CAST(120.0 AS DOUBLE) + ((s_suppkey*37) % (4700))/CAST(100.0 AS DOUBLE) AS lon,
  concat('src', ((s_suppkey) % (6))) AS source FROM supplier""",
    "listings": """
SELECT o_orderkey AS pet_id, concat('Pet ', o_orderkey) AS name,
  CASE ((o_orderkey) % (5)) WHEN 0 THEN 'dog' WHEN 1 THEN 'cat' WHEN 2 THEN 'rabbit' WHEN 3 THEN 'bird' ELSE 'other' END AS species,
  CASE ((o_custkey) % (5)) WHEN 0 THEN 'baby' WHEN 1 THEN 'young' WHEN 2 THEN 'adult' WHEN 3 THEN 'senior' ELSE 'unknown' END AS age_group,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'xs' WHEN '2-HIGH' THEN 's' WHEN '3-MEDIUM' THEN 'm' WHEN '4-NOT SPECIFIED' THEN 'unknown' ELSE 'l' END AS size,
  CASE ((o_orderkey) % (3)) WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS sex,
  CASE ((o_custkey) % (3)) WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'unknown' END AS compat_kids,
  CASE ((o_orderkey) % (4)) WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'unknown' END AS house_trained,
  CASE o_orderstatus WHEN 'O' THEN 'available' WHEN 'P' THEN 'pending' ELSE 'adopted' END AS status,
  CASE WHEN ((o_orderkey) % (11))=0 THEN '' ELSE c_mktsegment END AS raw_breed_text,
  ((o_orderkey) % (2))=0 AS is_mixed, o_custkey AS cust_id,
  ((o_custkey) % (nsupp)) AS org_id, concat('City ', c_nationkey) AS city, o_orderdate AS updated_at, o_totalprice AS fee,
  CASE WHEN ((o_orderkey) % (13))=0 THEN NULL ELSE CAST(25.0 AS DOUBLE) + ((o_orderkey*37) % (230))/CAST(10.0 AS DOUBLE) END AS lat,
  CASE WHEN ((o_orderkey) % (13))=0 THEN NULL ELSE -CAST(120.0 AS DOUBLE) + ((o_orderkey*53) % (470))/CAST(10.0 AS DOUBLE) END AS lon
FROM orders JOIN customer ON c_custkey=o_custkey CROSS JOIN (SELECT count(*) AS nsupp FROM supplier) z""",
    "photos": """
SELECT l_orderkey AS pet_id, l_linenumber AS sort_order, l_returnflag='R' AS is_primary,
  concat('https://img.example/', l_partkey, '-', l_suppkey, '.jpg') AS url, concat('data:image/webp;', l_partkey) AS blur, l_partkey, l_suppkey, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS photo_id FROM lineitem""",
    "links": """
SELECT l_orderkey AS pet_id, l_linenumber AS line_no, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS link_id, l_partkey, l_suppkey,
  concat('src', ((l_suppkey) % (6))) AS source, l_suppkey AS site, ((l_suppkey) % (20)) AS org_id,
  CASE l_returnflag WHEN 'A' THEN 'available' WHEN 'N' THEN 'pending' ELSE 'adopted' END AS status,
  l_shipdate AS last_seen_at, lpad(cast(l_partkey AS STRING), 8, '0') AS org_internal_animal_id FROM lineitem""",
    "zips": """
SELECT lpad(cast(10000 + n_nationkey AS STRING), 5, '0') AS zip, CAST(26.0 AS DOUBLE) + n_nationkey AS lat, -CAST(118.0 AS DOUBLE) + n_nationkey*CAST(1.5 AS DOUBLE) AS lon FROM nation""",
    "er_records": """
SELECT d.doc_id AS pet_id, d.lang AS species, d.source,
  concat(CASE ((d.n_chars) % (7)) WHEN 0 THEN 'Bella' WHEN 1 THEN 'Belle' WHEN 2 THEN 'Luna' WHEN 3 THEN 'Lunar' WHEN 4 THEN 'Rocky' WHEN 5 THEN 'Rocco' ELSE 'Max' END, ' ',
    CASE ((d.doc_id) % (5)) WHEN 0 THEN 'Mae' WHEN 1 THEN 'May' WHEN 2 THEN 'the Third' WHEN 3 THEN '(with Max)' ELSE '' END) AS name, d.text AS description,
  CASE ((d.n_chars) % (5)) WHEN 0 THEN 'baby' WHEN 1 THEN 'young' WHEN 2 THEN 'adult' WHEN 3 THEN 'senior' ELSE 'unknown' END AS age_group,
  CASE ((d.doc_id) % (9)) WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS sex, CASE WHEN ((d.doc_id) % (13))=0 THEN 'removed' ELSE 'available' END AS status,
  CASE l.toxic WHEN 1 THEN 'true' WHEN 0 THEN 'false' ELSE 'unknown' END AS house_trained,
  concat('o', (d.n_chars*37) % (norgs)) AS org_id, d.source || ' ' || CASE ((d.n_chars) % (3)) WHEN 0 THEN 'Hound' WHEN 1 THEN 'Hounds' ELSE '' END AS breed,
  CAST(25.0 AS DOUBLE) + ((d.n_chars*37) % (230))/CAST(10.0 AS DOUBLE) AS lat, -CAST(120.0 AS DOUBLE) + ((d.n_chars*53) % (470))/CAST(10.0 AS DOUBLE) AS lon,
  concat(substring(md5(d.text),1,15), cast(((d.doc_id) % (8)) AS STRING)) AS phash, v.embedding FROM documents d
  CROSS JOIN (SELECT 1 + cast(floor(count(*)/25) AS BIGINT) AS norgs FROM documents) z LEFT JOIN labels l ON l.doc_id=d.doc_id LEFT JOIN embeddings v ON v.vec_id=d.doc_id""",
    "runs": """
SELECT event_type AS source, event_id AS run_id, ts AS finished_at, ((event_id) % (7))<>0 AS ok,
  cast(floor(value) AS BIGINT) AS fetched, ((event_id) % (9)) AS quarantined FROM events""",
    "reports": """
SELECT ((event_id) % (n3)) AS pet_id, user_id AS fingerprint, ts AS created_at, event_type='error' AS resolved FROM events CROSS JOIN (SELECT cast(floor(count(*)/3) AS BIGINT) AS n3 FROM events) z""",
    "state": """
SELECT o_orderkey AS external_id, concat('src', ((o_custkey) % (6))) AS source, CASE WHEN ((o_custkey) % (6))<3 THEN NULL ELSE concat('a', ((o_custkey) % (4))) END AS site,
  o_totalprice AS fee, o_orderpriority AS label, CASE WHEN ((o_orderkey) % (17))=0 THEN 'removed' ELSE 'available' END AS status, o_orderdate AS last_seen_at,
  CASE WHEN ((o_orderkey) % (19))<>0 THEN CAST(o_orderdate AS TIMESTAMP) END AS first_seen_at, CASE WHEN ((o_orderkey) % (17))=0 THEN CAST(o_orderdate AS TIMESTAMP) END AS removed_at, CAST(((o_orderkey) % (2)) AS INT) AS version
  FROM orders WHERE ((o_orderkey) % (10))<>1""",
    "batch": """
SELECT o_orderkey AS external_id, concat('src', ((o_custkey) % (6))) AS source, CASE WHEN ((o_custkey) % (6))<3 THEN NULL ELSE concat('a', ((o_custkey) % (4))) END AS site,
  CASE WHEN ((o_orderkey) % (7))=0 THEN o_totalprice+CAST(1.0 AS DOUBLE) ELSE o_totalprice END AS fee, o_orderpriority AS label, 'available' AS status
  FROM orders WHERE ((o_orderkey) % (10))<>2""",
    "parts_tagged": """
SELECT p_partkey AS pet_id, p_name, p_brand AS breed_primary, CASE WHEN ((p_partkey) % (4))=0 THEN p_type END AS breed_secondary,
  CASE WHEN ((p_partkey) % (5))=0 THEN NULL ELSE ((p_partkey) % (2))=0 END AS mixed, CASE ((p_partkey) % (3)) WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS kids_ok, split(p_name, ' ') AS tags FROM part""",
    "raw_animals": """
SELECT p_partkey AS id, p_name AS animal_name, p_type AS species_name, p_brand AS breed_name,
  CASE ((p_partkey) % (4)) WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN 'Over 12' ELSE NULL END AS good_with_kids,
  p_size AS image_count, concat('acct', ((p_partkey) % (nsupp + 3))) AS account,
  CASE WHEN ((p_partkey) % (19))=0 THEN NULL ELSE concat(cast(1988 + ((p_partkey) % (12)) AS STRING), '-03-01') END AS date_of_birth FROM part CROSS JOIN (SELECT count(*) AS nsupp FROM supplier) z""",
    "saved": """
SELECT c_custkey AS user_id, CASE ((c_custkey) % (5)) WHEN 0 THEN 'dog' WHEN 1 THEN 'cat' WHEN 2 THEN 'rabbit' WHEN 3 THEN 'bird' ELSE 'other' END AS species,
  CASE ((c_custkey) % (4)) WHEN 0 THEN 10 WHEN 1 THEN 25 WHEN 2 THEN 50 ELSE 100 END AS radius, CAST(25.0 AS DOUBLE) + ((c_custkey*29) % (2300))/CAST(100.0 AS DOUBLE) AS lat,
  -CAST(120.0 AS DOUBLE) + ((c_custkey*31) % (4700))/CAST(100.0 AS DOUBLE) AS lon, CASE WHEN ((c_custkey) % (6))=0 THEN NULL ELSE ((c_custkey) % (20)) END AS last_seen_total FROM customer""",
    "favourites": """
SELECT user_id, event_id*3 AS pet_id, ts AS added_at FROM events WHERE event_type='click'""",
    "profiles": """
SELECT c_custkey AS user_id, CASE ((c_custkey) % (4)) WHEN 0 THEN 'apartment' WHEN 1 THEN 'house_yard' WHEN 2 THEN 'house_no_yard' ELSE 'rural' END AS home,
  CASE ((c_custkey) % (3)) WHEN 0 THEN 'little' WHEN 1 THEN 'big' ELSE 'none' END AS kids, c_mktsegment AS segment FROM customer""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view, planned over the Parquet tables of sf_dir."""
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", VIEWS[name])]
    sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", VIEWS[name])
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def with_views(*names: str, recursive: bool = False) -> str:
    """A WITH clause that defines the views, for DuckDB; more common table expressions may follow a comma."""
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
