"""Self-describing nested values, as variants made from JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(c: Column) -> Column:
    """The value of a JSON text, null where it is malformed. Of repeated keys in one object the text counts as malformed."""
    return F.try_parse_json(c)


def at(value: Column, path: str, kind: str) -> Column:
    """What stands at a path (like $.a[1]), as a type; null where it is absent or of another type."""
    return F.try_variant_get(value, path, kind)


def is_null(value: Column, path: str) -> Column:
    """Whether the path holds an explicit null (an absent path does not)."""
    return F.coalesce(F.is_variant_null(F.try_variant_get(value, path, "variant")), F.lit(False))


def is_undefined(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant").isNull()


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def to_json(value: Column) -> Column:
    return F.to_json(value)


def build(**fields: Column) -> Column:
    """A nested object of columns; each name can stand once."""
    return F.to_variant_object(F.struct(*(c.alias(n) for n, c in fields.items())))
