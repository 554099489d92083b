"""Null-safe conditions: comparisons of columns with constants under and, or."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A column in a condition; == with a constant makes a condition in which null equals null and NaN equals nothing."""

    name: str

    def __eq__(self, value):  # noqa: D105
        if isinstance(value, (Field, Condition)):
            raise TypeError("a column is compared with a constant")
        return Condition(lambda df: _equal(df, self.name, value))

    __hash__ = None


@dataclass(frozen=True)
class Condition:
    on: object

    def __and__(self, other: Condition) -> Condition:
        return Condition(lambda df: self.on(df) & other.on(df))

    def __or__(self, other: Condition) -> Condition:
        return Condition(lambda df: self.on(df) | other.on(df))


def _equal(df: DataFrame, name: str, value) -> Column:
    kind = df.schema[name].dataType
    test = F.col(name).eqNullSafe(F.lit(value))
    return test & ~F.isnan(F.col(name)) if isinstance(kind, (T.FloatType, T.DoubleType)) and value is not None else test


class Query:
    """Rows of a table as a smaller class, narrowed by conditions that all hold."""

    def __init__(self, df: DataFrame, columns: list[str] | None = None):
        self.source, self.columns, self.conditions = df, columns or df.columns, []

    def where(self, condition: Condition) -> Query:
        out = Query(self.source, self.columns)
        out.conditions = [*self.conditions, condition]
        return out

    def df(self) -> DataFrame:
        out = self.source
        for c in self.conditions:
            out = out.where(c.on(out))
        return out.select(*self.columns)
