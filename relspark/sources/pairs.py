"""Ordered binary pairs (key, value): what a cursor finds. Keys compare as unsigned bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_prefix(key: Column, prefix: bytes) -> Column:
    return F.startswith(key, F.lit(prefix))


def first(pairs: DataFrame, prefix: bytes = b"") -> DataFrame:
    return pairs.where(with_prefix(F.col("key"), prefix)).orderBy("key").limit(1)


def last(pairs: DataFrame, prefix: bytes = b"") -> DataFrame:
    return pairs.where(with_prefix(F.col("key"), prefix)).orderBy(F.col("key").desc()).limit(1)


def after(pairs: DataFrame, key: bytes) -> DataFrame:
    return pairs.where(F.col("key") > F.lit(key)).orderBy("key").limit(1)


def before(pairs: DataFrame, key: bytes) -> DataFrame:
    return pairs.where(F.col("key") < F.lit(key)).orderBy(F.col("key").desc()).limit(1)


def find(pairs: DataFrame, key: bytes, prefix: bytes = b"") -> DataFrame:
    """The pair with the key, else the one before, else the one after, with how (exact, previous, next)."""
    k = F.col("key")
    how = F.when(k == F.lit(key), "exact").when(k < F.lit(key), "previous").otherwise("next")
    place = F.when(k == F.lit(key), 0).when(k < F.lit(key), 1).otherwise(2)
    low = pairs.where(with_prefix(k, prefix) & (k <= F.lit(key))).orderBy(k.desc()).limit(1)
    high = pairs.where(with_prefix(k, prefix) & (k > F.lit(key))).orderBy(k).limit(1)
    return low.union(high).withColumn("how", how).orderBy(place).limit(1)


def index_of(pairs: DataFrame, key: bytes, prefix: bytes = b"") -> DataFrame:
    """How many keys of the prefix come before."""
    return pairs.where(with_prefix(F.col("key"), prefix) & (F.col("key") < F.lit(key))).agg(F.count("*").alias("at"))


def count(pairs: DataFrame, prefix: bytes = b"") -> DataFrame:
    return pairs.where(with_prefix(F.col("key"), prefix)).agg(F.count("*").alias("n"))


def erase_all(pairs: DataFrame, prefix: bytes) -> DataFrame:
    return pairs.where(~with_prefix(F.col("key"), prefix))


def erase_up_to(pairs: DataFrame, low: bytes, high: bytes) -> DataFrame:
    """Without the keys from low to high, both included."""
    return pairs.where(~F.col("key").between(F.lit(low), F.lit(high)))


def put(pairs: DataFrame, new: DataFrame) -> DataFrame:
    return pairs.join(new, "key", "left_anti").unionByName(new)


def update_suffix(pairs: DataFrame, prefix: bytes, key: bytes) -> tuple[DataFrame, str]:
    """Gives the only key with the prefix a new suffix. Result: Updated, NothingToDo, NotFound or NotUniquePrefix."""
    some = pairs.where(with_prefix(F.col("key"), prefix)).limit(2).collect()
    if len(some) != 1:
        return pairs, "NotUniquePrefix" if some else "NotFound"
    old = bytes(some[0].key)
    if old == key:
        return pairs, "NothingToDo"
    return pairs.withColumn("key", F.when(F.col("key") == F.lit(old), F.lit(key)).otherwise(F.col("key"))), "Updated"
