"""Column builders on hashes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(df: DataFrame, *leave_out: str) -> Column:
    """SHA-256 of the row as JSON, columns in name order, without those left out."""
    columns = [F.col(c) for c in sorted(df.columns) if c not in leave_out]
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def hash_bits(c: Column) -> Column:
    """A hexadecimal hash of up to 64 bits as a number."""
    return F.conv(c, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal hashes of up to 64 bits; null for unlike lengths."""
    return F.when(F.length(a) == F.length(b), F.bit_count(hash_bits(a).bitwiseXOR(hash_bits(b))))


def bits_to_hex(c: Column) -> Column:
    return F.lower(F.lpad(F.conv(c, 2, 16), 16, "0"))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def object_key(url: Column) -> Column:
    """Name of the stored copy of an image."""
    return F.concat(F.sha1(url), F.lit(".jpg"))


def source_kind(source: Column) -> Column:
    """'a:b' -> 'a'."""
    return F.substring_index(source, ":", 1)


def source_site(source: Column) -> Column:
    """'a:b:c' -> 'b:c'; null without a colon."""
    return F.when(F.contains(source, F.lit(":")), F.substring(source, F.instr(source, ":") + 1, F.length(source)))


def bare_id(c: Column) -> Column:
    """An in-house id in lower case without leading zeros; null when nothing is left."""
    bare = F.regexp_replace(F.lower(c), "^0+", "")
    return F.when(F.trim(bare) != "", bare)
