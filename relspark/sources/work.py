"""Tables kept for the length of a job in the shared folder, and ranks that take no single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def work_path(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local folder serves a local master (tests); any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("relspark.work.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("relspark.work.dir", base)
    return f"{base.rstrip('/')}/relspark-work/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    path = work_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[Column], to: str = "rn") -> DataFrame:
    """Rows with their rank from 1 in the order: ranges are sorted apart, and moved up by the rows before them."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = kept(ranges.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).count()  # a row for each range, so one task may order them
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumn(to, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")
