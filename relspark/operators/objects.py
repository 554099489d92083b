"""Objects of several types in one table, by object id (oid), with their content in the other columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.operators.stats import size_of
from relspark.sources.work import ranked


class Objects:
    """Rows of oid long, type string and content. Each method gives a DataFrame or new Objects; nothing is changed in place."""

    def __init__(self, df: DataFrame):
        self.df = df

    def enumerate(self, kind: str | None = None) -> DataFrame:
        """All objects, or those of a type, by oid."""
        df = self.df.where(F.col("type") == kind) if kind is not None else self.df
        return df.orderBy("oid")

    def get(self, oid: int) -> DataFrame:
        return self.df.where(F.col("oid") == oid)

    def sized(self) -> DataFrame:
        """oid, type and size: the bytes of the content as text."""
        return self.df.select("oid", "type", size_of([c for c in self.df.columns if c not in ("oid", "type")]).alias("size"))

    def store(self, new: DataFrame) -> Objects:
        """With these objects: those with an oid take the place of what has it, those without get the next ones in the order of their content."""
        most = self.df.union(new.select(*self.df.columns)).agg(F.coalesce(F.max("oid"), F.lit(0)).alias("most"))
        content = [F.col(c) for c in self.df.columns if c != "oid"]
        placed = ranked(new.where("oid is null").select(*self.df.columns), content, "_rn").join(F.broadcast(most))  # one row
        fresh = placed.withColumn("oid", F.col("most") + F.col("_rn")).select(*self.df.columns)
        given = new.where("oid is not null").select(*self.df.columns)
        return Objects(self.df.join(given.select("oid"), "oid", "left_anti").select(*self.df.columns).union(given).union(fresh))

    def delete(self, oid: int) -> tuple[Objects, DataFrame]:
        """Without this object, and how many that were."""
        return Objects(self.df.where(F.col("oid") != oid)), self.get(oid).agg(F.count("*").alias("removed"))

    def delete_all(self, kind: str) -> Objects:
        return Objects(self.df.where(F.col("type") != kind))

    def singleton(self, kind: str) -> DataFrame:
        """The only object of a type: the one with the least oid; no row if there is none."""
        return self.df.where(F.col("type") == kind).orderBy("oid").limit(1)
