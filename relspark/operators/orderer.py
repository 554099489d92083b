"""Sort orders with explicit places for nulls: ascending, strings put null last and other types first; descending is the reverse."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Orderer:
    column: str
    descending: bool = False
    locale: str | None = None
    """An ICU collation, for strings."""

    def backwards(self) -> Orderer:
        return replace(self, descending=not self.descending)

    def by(self, df: DataFrame) -> Column:
        c = F.col(self.column)
        last = isinstance(df.schema[self.column].dataType, T.StringType)
        if self.locale:
            c = F.collate(c, self.locale)
        if self.descending:
            return c.desc_nulls_first() if last else c.desc_nulls_last()
        return c.asc_nulls_last() if last else c.asc_nulls_first()


def ascending(column: str) -> Orderer:
    return Orderer(column)


def descending(column: str) -> Orderer:
    return Orderer(column, True)


def by_locale(column: str, locale: str) -> Orderer:
    return Orderer(column, locale=locale)


def sort_key(df: DataFrame, columns: list[str]) -> Column:
    """A value that compares as the columns do in ascending order, for min_by and max_by."""
    parts = []
    for k, c in enumerate(columns):
        last = isinstance(df.schema[c].dataType, T.StringType)
        parts += [(F.col(c).isNull() if last else F.col(c).isNotNull()).alias(f"n{k}"), F.col(c).alias(f"v{k}")]
    return F.struct(*parts)
