"""Scalar functions: prefixed words, 64-bit signatures, and readers of single JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitide.catalog import MOST_WORD


def prefix_concat(prefix: Column | str, word: Column) -> Column:
    """prefix and word as one; null if that has more than 255 bytes."""
    whole = F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, word)
    return F.when(F.octet_length(whole) <= MOST_WORD, whole)


def _word32(digest: Column, i: int) -> Column:
    """The i-th little-endian unsigned 32-bit number of a hexadecimal digest."""
    byte = lambda k: F.substring(digest, 8 * i + 2 * k + 1, 2)
    return F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("long")


def sign64(whole: Column) -> tuple[Column, Column]:
    """(high, low) unsigned 32-bit halves of a word's signature: sums modulo 2^32 of the digest's first two and last two numbers."""
    d = F.md5(whole)
    return (_word32(d, 0) + _word32(d, 1)) % (1 << 32), (_word32(d, 2) + _word32(d, 3)) % (1 << 32)


def b64_decode(text: Column) -> Column:
    """Bytes, null if the text isn't base64."""
    return F.try_to_binary(text, F.lit("base64"))


def json_object(text: Column) -> Column:
    """map<string, variant> of a JSON object, null for anything else."""
    return F.from_json(text, "map<string,variant>", {"allowNonNumericNumbers": "false"})


def json_fields(text: Column, names: list[str]) -> Column:
    """A struct with the variants of the named keys of a JSON object, null where a key isn't there; of a key that repeats,
    the last one. One parse gives all of them."""
    return F.from_json(text, T.StructType([T.StructField(n, T.VariantType()) for n in names]), {"allowNonNumericNumbers": "false"})


def value_of(entries: Column, name: str) -> Column:
    """The variant of a key of a map, null if it isn't there; of a key that repeats, the last one."""
    mine = F.filter(F.map_entries(entries), lambda e: e["key"] == F.lit(name))
    return F.when(F.size(mine) > 0, F.element_at(mine, -1)["value"])


def is_kind(value: Column, *kinds: str) -> Column:
    """Whether a variant's type is one of kinds, or begins with one that ends in *."""
    name, out = F.schema_of_variant(value), F.lit(False)
    for k in kinds:
        out = out | (name.startswith(k[:-1]) if k.endswith("*") else name == k)
    return F.coalesce(out, F.lit(False))


def is_number(value: Column) -> Column:
    return is_kind(value, "BIGINT", "DOUBLE", "DECIMAL*", "FLOAT", "INT", "SMALLINT", "TINYINT")


def num_to_int(value: Column) -> Column:
    """A JSON number cut to an int; null for other kinds and for numbers beyond 32 bits."""
    x = F.when(is_number(value), F.try_variant_get(value, "$", "double"))
    return F.when(F.abs(x) < 2147483648.0, x.cast("int"))


def num_to_float(value: Column) -> Column:
    return F.when(is_number(value), F.try_variant_get(value, "$", "double")).cast("float")
