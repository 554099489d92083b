"""Keyed changes. Each takes DataFrames and gives the new content and a one-row DataFrame of counts; nothing is changed in place.

A merge shuffles both sides once by key; what is only filtered stays where it is. Keys compare null-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspark.operators.orderer import Orderer
from relspark.operators.relation import NotFound, Range, RelationDef
from relspark.operators.stats import size_of
from relspark.sources.work import ranked


def normalized(new: DataFrame, hooks: dict[str, Column]) -> DataFrame:
    """Rows as they are to be stored: each hook gives a column's value from the row, before any key is compared."""
    return new.withColumns(hooks)


def _absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    return new.alias("n").join(old.alias("o"), _on(keys), "left_anti")


def _present(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    return new.alias("n").join(old.alias("o"), _on(keys), "left_semi")


def _counts(new: DataFrame, fresh: DataFrame, rest: str) -> DataFrame:
    """inserted (the fresh rows) and the other new rows, from one pass over each."""
    marks = new.select(F.lit(1).alias("a"), F.lit(0).alias("f")).unionAll(fresh.select(F.lit(0), F.lit(1)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return marks.agg(total("f").alias("inserted"), (total("a") - total("f")).alias(rest))


def _on(keys: list[str]) -> Column:
    on = F.col(f"n.{keys[0]}").eqNullSafe(F.col(f"o.{keys[0]}"))
    for k in keys[1:]:
        on &= F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
    return on


def insert(old: DataFrame, new: DataFrame, d: RelationDef, on_create: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Adds rows whose key is absent; rows of present keys are left out. Counts: inserted, rejected. new: keys are unique.
    on_create: values of columns that are set in rows as they are added."""
    fresh = _absent(new, old, d.unique)
    counts = _counts(new, fresh, "rejected")
    return old.unionByName(fresh.withColumns(on_create or {})), counts


def upsert(old: DataFrame, new: DataFrame, d: RelationDef, sequence: str | None = None, on_create: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """New rows take the place of those with their key. With a sequence column, later rows of one key win and count
    as updates, as if they came one by one. on_create: values of columns that are set in rows whose key was absent.
    Counts: inserted, updated."""
    columns = old.columns
    if sequence:
        w = Window.partitionBy(*d.unique).orderBy(F.col(sequence).desc())
        numbered = new.withColumns({"_rn": F.row_number().over(w)})
        last = numbered.where("_rn = 1").select(*columns)
    else:
        last = new.select(*columns)
    fresh = _absent(last, old, d.unique)
    counts = _counts(new, fresh, "updated")
    if on_create:
        last = fresh.withColumns(on_create).unionByName(_present(last, old, d.unique))
    return _absent(old, last, d.unique).unionByName(last), counts


def upsert_with_sizes(old: DataFrame, new: DataFrame, d: RelationDef) -> tuple[DataFrame, DataFrame]:
    """As upsert; counts: bytes of the keys and values written and of those replaced (of the columns as text)."""
    values = [c for c in old.columns if c not in d.pk]
    sizes = lambda df, name: df.select(F.lit(name).alias("what"), size_of(d.pk).alias("k"), size_of(values).alias("v"))
    marks = sizes(new, "new").unionAll(sizes(_present(old, new, d.unique), "old"))
    total = lambda what, c: F.coalesce(F.sum(F.when(F.col("what") == what, F.col(c))), F.lit(0))
    counts = marks.agg(*(total(w, c).alias(f"{w}_{n}_bytes") for w in ("new", "old") for c, n in (("k", "key"), ("v", "value"))))
    return upsert(old, new, d)[0], counts


def update(old: DataFrame, new: DataFrame, d: RelationDef) -> tuple[DataFrame, DataFrame]:
    """As upsert, but keys that are absent raise NotFound."""
    if not _absent(new, old, d.unique).isEmpty():
        raise NotFound("a row to update has no match")
    return upsert(old, new, d)


def update_by_id(old: DataFrame, key: dict[str, object], values: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """Sets columns of the rows with these key values (columns of the key included, as for a changed in-key suffix)."""
    hit = F.lit(True)
    for k, v in key.items():
        hit &= F.col(k).eqNullSafe(F.lit(v))
    new = old.select(*(F.when(hit, F.lit(values[c]).cast(old.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns))
    return new, old.where(hit).agg(F.count("*").alias("updated"))


def _prefix(d: RelationDef, prefix: tuple, bounds: Range | None) -> Column:
    hit = F.lit(True)
    for c, v in zip(d.pk, prefix):
        hit &= F.col(c).eqNullSafe(F.lit(v))
    return hit & F.coalesce(bounds.on(F.col(d.pk[len(prefix)])), F.lit(False)) if bounds else hit


def remove(old: DataFrame, d: RelationDef, *prefix, bounds: Range | None = None, veto: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Removes the rows with these leading key values (and in this range of the next one). veto: rows to keep in any case."""
    hit = _prefix(d, prefix, bounds)
    hit = hit & ~F.coalesce(veto, F.lit(False)) if veto is not None else hit
    return old.where(~hit), old.where(hit).agg(F.count("*").alias("removed"))


def remove_partial(old: DataFrame, d: RelationDef, limit: int, *prefix, veto: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Removes the first rows with these leading key values in key order; rows under veto count towards the limit and stay."""
    some = old.where(_prefix(d, prefix, None)).orderBy(*(Orderer(c).by(old) for c in d.pk)).limit(limit)
    gone = some.where(~F.coalesce(veto, F.lit(False))) if veto is not None else some
    return _absent(old, gone.select(*d.unique), d.unique), gone.agg(F.count("*").alias("removed"))


def remove_all(old: DataFrame, veto: Column | None = None) -> DataFrame:
    return old.where(F.coalesce(veto, F.lit(False))) if veto is not None else old.limit(0)


def remove_with_sizes(old: DataFrame, d: RelationDef, *prefix) -> tuple[DataFrame, DataFrame]:
    """As remove; counts: removed, key_bytes and value_bytes (of the columns as text)."""
    hit = _prefix(d, prefix, None)
    values = [c for c in old.columns if c not in d.pk]
    counts = old.where(hit).agg(F.count("*").alias("removed"), F.coalesce(F.sum(size_of(d.pk)), F.lit(0)).alias("key_bytes"), F.coalesce(F.sum(size_of(values)), F.lit(0)).alias("value_bytes"))
    return old.where(~hit), counts


def cascade(content: DataFrame, owner: str, rows: DataFrame, key: str) -> DataFrame:
    """Content whose owner is still there."""
    return content.join(rows.select(F.col(key).alias(owner)).distinct(), owner, "left_semi")


def allocate_ids(new: DataFrame, order: list[Column], start: int, to: str) -> DataFrame:
    """Rows with ids from start on, in the order."""
    return ranked(new, order, "_rn").withColumn(to, F.col("_rn") + (start - 1)).drop("_rn")
