"""Conversions between a field's old and new type. Numbers wrap as unchecked conversions do; nothing raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def wrap(c: Column, kind: str) -> Column:
    """A whole number as a narrower one: the low bits, as a signed number."""
    bits = BITS[kind]
    if bits == 64:
        return c.cast("bigint")
    wide = c.cast("bigint").bitwiseAND((1 << bits) - 1)
    return F.when(wide >= 1 << (bits - 1), wide - (1 << bits)).otherwise(wide).cast(kind)


def truncated(c: Column, kind: str = "bigint") -> Column:
    """A floating-point number as a whole one, towards zero; null where it has none of that size."""
    return F.when(F.isnan(c), None).otherwise(F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).try_cast(kind))


def to_text(c: Column, kind: str) -> Column:
    """Booleans are 1 and 0."""
    return F.when(c, "1").when(~c, "0") if kind == "boolean" else c.cast("string")


def to_decimal(c: Column, precision: int = 38, scale: int = 10) -> Column:
    return c.try_cast(f"decimal({precision},{scale})")


def to_boolean(c: Column) -> Column:
    return c != 0


def not_null(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def to_list(c: Column) -> Column:
    """A single value as a list; null is the empty list."""
    return F.array_compact(F.array(c))


def version_parts(c: Column) -> Column:
    """A dotted version of two to four numbers as a struct; parts that are missing are -1."""
    part = lambda k: F.coalesce(F.get(F.split(c, r"\."), F.lit(k)).try_cast("int"), F.lit(-1))
    return F.struct(*(part(k).alias(n) for k, n in enumerate(("major", "minor", "build", "revision"))))


def version_text(c: Column) -> Column:
    parts = F.array(*(c[n] for n in ("major", "minor", "build", "revision")))
    return F.array_join(F.transform(F.filter(parts, lambda x: x >= 0), lambda x: x.cast("string")), ".")


def enum_name(c: Column, names: dict[int, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), c)


def enum_value(c: Column, names: dict[int, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in names.items() for x in (v, k))), c)


def encrypted(c: Column, key: str) -> Column:
    """Text under a key, so that equal texts stay equal (ECB) and nothing else is told."""
    return F.base64(F.aes_encrypt(c, F.lit(key), F.lit("ECB"), F.lit("PKCS")))


def decrypted(c: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(c), F.lit(key), F.lit("ECB"), F.lit("PKCS")).cast("string")
