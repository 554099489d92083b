"""Counts by key, histograms, sizes, differences between tables, and rows that nothing reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def size_of(columns: list[str]) -> Column:
    return sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0))


def size_histograms(df: DataFrame, keys: list[str]) -> DataFrame:
    """kind (key or value), size, n: how many rows have keys and values of each size, in one pass."""
    values = [c for c in df.columns if c not in keys]
    sizes = F.array(F.struct(F.lit("key").alias("kind"), size_of(keys).alias("size")), F.struct(F.lit("value").alias("kind"), size_of(values).alias("size")))
    return df.select(F.explode(sizes).alias("s")).groupBy("s.kind", "s.size").agg(F.count("*").alias("n"))


def version_histogram(df: DataFrame, version: str) -> DataFrame:
    """version, n: how many rows were written under each version of their class."""
    return df.groupBy(F.col(version).alias("version")).agg(F.count("*").alias("n"))


def type_report(df: DataFrame, kind: str) -> DataFrame:
    """Rows and bytes of each type."""
    return df.groupBy(kind).agg(F.count("*").alias("n"), F.sum(size_of([c for c in df.columns if c != kind])).alias("bytes"))


def key_bounds(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("least"), F.max(column).alias("most"))


def unreachable(items: DataFrame, item: str, links: DataFrame, to: str) -> DataFrame:
    """Items that no link points to."""
    return items.join(links.select(F.col(to).alias(item)).distinct(), item, "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, repeats counted, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: the rows of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
