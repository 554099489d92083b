"""Ordered dictionaries and sets as rows (owner, key[, value]), and bitmaps as rows (owner, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.operators.relation import Range
from relspark.sources.work import kept

PAGE_BITS = 65_536


class OrderedDictionary:
    """One dictionary: rows of key and, unless it is a set, value. Keys are unique."""

    def __init__(self, df: DataFrame, key: str = "key", value: str | None = "value"):
        self.df, self.key, self.value = df, key, value

    def _with(self, df: DataFrame) -> OrderedDictionary:
        return OrderedDictionary(df, self.key, self.value)

    def get(self, key) -> DataFrame:
        return self.df.where(F.col(self.key) == F.lit(key))

    def contains(self, key) -> DataFrame:
        return self.get(key).agg((F.count("*") > 0).alias("found"))

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))

    def keys(self) -> DataFrame:
        return self.df.select(self.key)

    def values(self) -> DataFrame:
        return self.df.select(self.value)

    def reverse(self) -> DataFrame:
        return self.df.orderBy(F.col(self.key).desc())

    def increasing(self, start) -> DataFrame:
        return self.df.where(F.col(self.key) >= F.lit(start)).orderBy(self.key)

    def decreasing(self, start) -> DataFrame:
        return self.df.where(F.col(self.key) <= F.lit(start)).orderBy(F.col(self.key).desc())

    def advanced(self, bounds: Range) -> DataFrame:
        hit = self.df.where(bounds.on(F.col(self.key)))
        return hit.orderBy(F.col(self.key).desc() if bounds.descending else F.col(self.key).asc())

    def add(self, key, value=None) -> OrderedDictionary:
        """With a new entry; KeyError if the key is there."""
        if not self.get(key).isEmpty():
            raise KeyError(key)
        return self.set(key, value)

    def set(self, key, value=None) -> OrderedDictionary:
        """With this entry, whatever the key held."""
        entry = self.df.sparkSession.range(1).select(*(F.lit(x).cast(self.df.schema[c].dataType).alias(c) for c, x in ((self.key, key), (self.value, value)) if c))
        return self._with(self.df.where(F.col(self.key) != F.lit(key)).unionByName(entry))

    def remove(self, key) -> tuple[OrderedDictionary, DataFrame]:
        """Without this key, and whether it was there."""
        return self._with(self.df.where(F.col(self.key) != F.lit(key))), self.contains(key)

    def clear(self) -> OrderedDictionary:
        return self._with(self.df.limit(0))

    def remove_range(self, bounds: Range) -> tuple[OrderedDictionary, DataFrame]:
        """Without the keys in the range (none if it is inverted), and how many they were."""
        hit = bounds.on(F.col(self.key))
        return self._with(self.df.where(~hit)), self.df.where(hit).agg(F.count("*").alias("removed"))

    def upsert(self, other: DataFrame) -> OrderedDictionary:
        """With the other's entries, which win."""
        return self._with(self.df.join(other, self.key, "left_anti").unionByName(other))

    def sizes(self) -> DataFrame:
        size = lambda c: F.octet_length(F.col(c).cast("string"))
        return self.df.select(self.key, size(self.key).alias("key_size"), *([size(self.value).alias("value_size")] if self.value else []))


def union_with(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def except_with(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


class Bitmap:
    """A lazy set of whole numbers from 0 on. Operations build a plan; nothing runs before df is used."""

    def __init__(self, df: DataFrame, negated: Bitmap | None = None, complete: bool = False):
        self._df, self.negated, self.complete = df, negated, complete

    @staticmethod
    def of(df: DataFrame, column: str) -> Bitmap:
        return Bitmap(df.select(F.col(column).cast("long").alias("value")).where("value >= 0").distinct())

    def either(self, other: Bitmap) -> Bitmap:
        return Bitmap(self.df.union(other.df).distinct())

    def both(self, other: Bitmap) -> Bitmap:
        if other.negated is not None:  # and not: no complement is made
            return self.without(other.negated)
        return Bitmap(self.df.join(other.df, "value", "left_semi"))

    def without(self, other: Bitmap) -> Bitmap:
        return Bitmap(self.df.join(other.df, "value", "left_anti"))

    def negate(self, most: int) -> Bitmap:
        """The numbers from 0 to most that are not here; twice is the bitmap itself, up to most."""
        if self.negated is not None:
            return Bitmap(self.negated.df.where(F.col("value") <= most))
        spark = self._df.sparkSession
        return Bitmap(spark.range(most + 1).select(F.col("id").alias("value")).join(self._df.where(F.col("value") <= most), "value", "left_anti"), self)

    @property
    def df(self) -> DataFrame:
        return self._df

    def build(self, most: int) -> DataFrame:
        return self.df.where(F.col("value") <= most)

    def built(self, most: int) -> Bitmap:
        """The numbers up to most, computed now and written to the shared folder."""
        return Bitmap(kept(self.build(most)), complete=True)

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))

    def get(self, value: int) -> DataFrame:
        return self.df.where(F.col("value") == value).agg((F.count("*") > 0).alias("found"))

    def set(self, value: int) -> Bitmap:
        return Bitmap(self.df.union(self.df.sparkSession.range(value, value + 1).toDF("value")).distinct())

    def clear(self, value: int) -> Bitmap:
        return Bitmap(self.df.where(F.col("value") != value))

    def pages(self) -> DataFrame:
        """page, n: how many numbers each page of PAGE_BITS holds."""
        return self.df.groupBy(page().alias("page")).agg(F.count("*").alias("n"))


def page(column: str = "value") -> Column:
    return F.floor(F.col(column) / PAGE_BITS)
