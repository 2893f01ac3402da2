"""Column builders on text: normalisation, labels, similarities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body) -> Column:
    """body(value), where value is worked out once however often body uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_null(c: Column) -> Column:
    return F.when(c != "", c)


def squeeze(c: Column) -> Column:
    """Runs of white space, Unicode's too, as one space, and none at the ends."""
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def tag_key(c: Column) -> Column:
    """Lower case, only letters, digits, underscores, hyphens and single spaces."""
    return squeeze(F.regexp_replace(F.lower(c), "(?U)[^a-zA-Z0-9_\\s-]", ""))


def lookup(c: Column, words: dict[str, str], default: str | None = None) -> Column:
    """The vocabulary's word for a label, trimmed and in lower case."""
    table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.coalesce(table[F.lower(strip(c))], F.lit(default))


def sex_word(c: Column) -> Column:
    word = F.lower(c)
    return F.when(word.isin("male", "female"), word).otherwise("unknown")


def tri(c: Column) -> Column:
    """Absent becomes 'unknown'."""
    return F.coalesce(c.cast("string"), F.lit("unknown"))


def yes_no(c: Column) -> Column:
    """yes and no as booleans; any other label is absent."""
    word = F.lower(strip(c))
    return F.when(word == "yes", True).when(word == "no", False)


def breed_text(primary: Column, secondary: Column) -> Column:
    return F.concat_ws(" / ", blank_null(primary), blank_null(secondary))


def is_mixed(flag: Column, primary: Column, secondary: Column) -> Column:
    parts = F.size(F.array_compact(F.array(blank_null(primary), blank_null(secondary))))
    return F.coalesce(flag, (parts > 1) | F.coalesce(primary.rlike("(?i)mix|cross"), F.lit(False)))


def age_label(c: Column) -> Column:
    return F.when(c.isin("baby", "young", "adult", "senior"), F.initcap(c)).otherwise("Age unknown")


def breed_label(breed: Column, mixed: Column) -> Column:
    return F.coalesce(blank_null(breed), F.when(mixed, "Mixed breed").otherwise("Breed unknown"))


def photo_alt(name: Column, age: Column, breed: Column) -> Column:
    return F.concat(name, F.lit(", a "), F.lower(age_label(age)), F.lit(" "), breed)


def joined(separator: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty, joined."""
    return F.concat_ws(separator, *(blank_null(p) for p in parts))


def clean_name(c: Column) -> Column:
    """Lower case without parentheses, notices of status and anything but letters."""
    c = F.regexp_replace(F.lower(c), "\\([^\\n\\r\\u2028\\u2029]*?\\)", " ")
    c = F.regexp_replace(c, "\\b(adopted|pending|courtesy|urgent|bonded)\\b[:!]?", " ")
    return squeeze(F.regexp_replace(c, "(?U)[^a-z\\s]", " "))


def padded(c: Column) -> Column:
    return F.concat(F.lit("  "), squeeze(F.lower(c)), F.lit(" "))


def trigrams(c: Column) -> Column:
    """The set of three-letter runs of the whole text, with two spaces before and one after."""
    three = lambda x, i: F.concat(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2))
    return let(F.split(padded(c), ""), lambda x: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: three(x, i))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as columns, which should be plain ones: each is read twice."""
    return let(F.size(F.array_intersect(a, b)), lambda shared: shared / (F.size(a) + F.size(b) - shared))


def trigram_similarity(a: Column, b: Column) -> Column:
    return let(F.struct(trigrams(a).alias("a"), trigrams(b).alias("b")), lambda t: jaccard(t["a"], t["b"]))


def _numbers(text: str) -> np.ndarray:
    """The distinct runs of three code points of a text, as numbers of 63 bits in order."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    g = np.sort(x[:-2] << 42 | x[1:-1] << 21 | x[2:])
    return g[np.append(True, g[1:] != g[:-1])] if len(g) else g


@F.arrow_udf(T.ArrayType(T.LongType()))
def _gram_numbers(texts: pa.Array) -> pa.Array:
    """_numbers of each text."""
    found, ends = [], np.zeros(len(texts) + 1, np.int32)
    for k, text in enumerate(texts):
        ends[k + 1] = ends[k]
        if text.is_valid:
            found.append(_numbers(text.as_py()))
            ends[k + 1] += len(found[-1])
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    offsets = pa.array(ends, pa.int32(), mask=np.append(~known, False))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else [], pa.int64()))


def gram_set(c: Column) -> Column:
    """The trigrams as numbers: for long texts, once per text, where many pairs are compared by the grams they share."""
    return _gram_numbers(padded(c))


#: Bytes of a number in a packed set before it is compressed, and how it is compressed.
PACKED, CODEC = 12, "zstd"


def _packed(g: np.ndarray, codec: pa.Codec) -> bytes:
    parts = np.concatenate([np.diff(g >> 42, prepend=0), g >> 21 & 0x1FFFFF, g & 0x1FFFFF]).astype("<i4")
    return codec.compress(np.ascontiguousarray(parts.view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


@F.arrow_udf(T.BinaryType())
def packed_grams(sets: pa.Array) -> pa.Array:
    """Sets of numbers as bytes, a fifth of what they are as longs: code points by themselves, the first as differences, the bytes of one weight side by side."""
    codec, out = pa.Codec(CODEC), []
    for x in sets:
        if not x.is_valid:
            out.append(None)
            continue
        out.append(_packed(x.values.to_numpy(zero_copy_only=False).astype(np.int64), codec))
    return pa.array(out, pa.binary())


@F.arrow_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("packed", T.BinaryType())]))
def _packed_numbers(texts: pa.Array) -> pa.Array:
    codec, counts, out = pa.Codec(CODEC), [], []
    for text in texts:
        g = _numbers(text.as_py()) if text.is_valid else None
        counts.append(None if g is None else len(g))
        out.append(None if g is None else _packed(g, codec))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), pa.array(out, pa.binary())], ["n", "packed"])


def packed_gram_set(c: Column) -> Column:
    """n and packed: the size of gram_set and its packed_grams in one step, so that sets do not come back from Python; null for both: no text."""
    return _packed_numbers(padded(c))


def unpacked_grams(data: bytes, n: int) -> np.ndarray:
    """The n numbers of packed_grams."""
    planes = np.frombuffer(pa.Codec(CODEC).decompress(data, decompressed_size=PACKED * n), np.uint8).reshape(4, -1)
    first, second, third = np.ascontiguousarray(planes.T).view("<i4").reshape(3, -1).astype(np.int64)
    return np.cumsum(first) << 42 | second << 21 | third


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity; the prefix always counts, and odd transpositions count half.

    A fold over the letters of `a` takes, for each, the first free equal letter of `b` within the window.
    """
    both = F.struct(a.alias("a"), b.alias("b"), F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    return let(both, lambda t: _jaro_winkler(t["a"], t["b"], t["x"], t["y"]))


def _jaro_winkler(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Of two texts and the arrays of their letters."""
    la, lb = F.length(a), F.length(b)
    window = F.greatest(F.lit(0), F.floor(F.greatest(la, lb) / 2).cast("int") - 1)
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<string>").alias("hit"))

    def step(state: Column, i: Column) -> Column:
        low, high = F.greatest(F.lit(0), i - window), F.least(lb - 1, i + window)
        near = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        letter = F.get(x, i)
        free = F.filter(near, lambda j: (F.get(y, j) == letter) & ~F.array_contains(state["taken"], j))
        more = lambda j: F.struct(F.concat(state["taken"], F.array(j)).alias("taken"), F.concat(state["hit"], F.array(letter)).alias("hit"))
        return let(F.get(free, F.lit(0)), lambda j: F.when(j.isNull(), state).otherwise(more(j)))

    def finish(state: Column) -> Column:
        m = F.size(state["hit"])
        other = F.transform(F.array_sort(state["taken"]), lambda j: F.get(y, j))
        moved = F.size(F.filter(F.zip_with(state["hit"], other, lambda u, v: u != v), lambda unlike: unlike))
        jaro = (m / la + m / lb + (m - moved / 2) / m) / 3
        same = [F.substring(a, F.lit(1), F.lit(k)) == F.substring(b, F.lit(1), F.lit(k)) for k in range(1, 5)]
        prefix = sum(((F.least(la, lb) >= k + 1) & same[k]).cast("int") for k in range(4))
        return F.when(m == 0, 0.0).otherwise(jaro + prefix * 0.1 * (1 - jaro))

    folded = F.aggregate(F.sequence(F.lit(0), F.greatest(la - 1, F.lit(0))), start, step, finish)
    return F.when(a == b, 1.0).when((la == 0) | (lb == 0), 0.0).otherwise(folded)
