"""Reading rows of several schema versions as the newest: fields that were added take a default, those removed are left out, types convert."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.functions import casts


@dataclass(frozen=True)
class Version:
    """A schema with its defaults, converters for fields whose conversion is not the usual one, names that fields had before,
    and, for fields of named values, the names that values had before."""

    schema: T.StructType
    defaults: dict[str, object] = field(default_factory=dict)
    convert: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    renamed: dict[str, str] = field(default_factory=dict)
    values: dict[str, dict[str, str]] = field(default_factory=dict)


def converted(c: Column, old: T.DataType, new: T.DataType) -> Column:
    if old == new:
        return c
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(new, T.ArrayType) and not isinstance(old, T.ArrayType):
        return casts.to_list(converted(c, old, new.elementType))
    if isinstance(old, whole) and isinstance(new, whole):
        return casts.wrap(c, new.simpleString())
    if isinstance(old, (T.FloatType, T.DoubleType)) and isinstance(new, whole):
        return casts.truncated(c, new.simpleString())
    if isinstance(old, whole) and isinstance(new, T.BooleanType):
        return casts.to_boolean(c)
    if isinstance(old, T.BooleanType) and isinstance(new, T.StringType):
        return casts.to_text(c, "boolean")
    return c.try_cast(new)


def upgraded(df: DataFrame, to: Version) -> DataFrame:
    def one(f: T.StructField) -> Column:
        name = f.name if f.name in df.columns else to.renamed.get(f.name)
        if name not in df.columns:
            return F.lit(to.defaults.get(f.name)).cast(f.dataType).alias(f.name)
        c = F.col(name)
        if known := to.values.get(f.name):
            c = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), c), c)
        return (to.convert[f.name](c) if f.name in to.convert else converted(c, df.schema[name].dataType, f.dataType)).alias(f.name)

    return df.select(*(one(f) for f in to.schema))


def read_versions(parts: list[DataFrame], to: Version) -> DataFrame:
    """All parts' rows in the newest schema."""
    out = upgraded(parts[0], to)
    for p in parts[1:]:
        out = out.unionByName(upgraded(p, to))
    return out


def check_key(old: T.StructType, new: T.StructType, keys: list[str]) -> None:
    """A key cannot change its columns or types."""
    for k in keys:
        if k not in old.names or k not in new.names or old[k].dataType != new[k].dataType:
            raise ValueError(f"the primary key's column {k} has changed")
