"""Event logs: batches appended with metadata, read from the start or from where a reader stopped.

A log is a folder of Parquet files with rows (batch_id, seq, metadata, type, payload). Incremental reading is a
streaming query with a checkpoint, run until no new files are left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "batch_id long, seq int, metadata string, type string, payload string"


def batches(events: DataFrame, batch: Column, order: Column, metadata: Column, kind: str) -> DataFrame:
    """Events as rows of a log: batch is a number, seq the place in it; the payload holds all other columns."""
    from pyspark.sql import Window

    rest = [c for c in events.columns if c != kind]
    return events.select(batch.cast("long").alias("batch_id"), (F.row_number().over(Window.partitionBy(batch).orderBy(order)) - 1).alias("seq"), metadata.alias("metadata"), F.col(kind).alias("type"), F.to_json(F.struct(*rest)).alias("payload"))


def append(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def observe(log: DataFrame, wanted: Column | None = None, types: list[str] | None = None, stop_after: int | None = None) -> DataFrame:
    """Rows of the batches that an observer takes: wanted sees metadata and n_events before any payload is decoded;
    events of other types are left out, and their batch shrinks; after batch stop_after nothing is read."""
    heads = log.groupBy("batch_id").agg(F.max("metadata").alias("metadata"), F.count("*").alias("n_events"))
    if stop_after is not None:
        heads = heads.where(F.col("batch_id") <= stop_after)
    if wanted is not None:
        heads = heads.where(F.coalesce(wanted, F.lit(False)))
    out = log.join(heads.select("batch_id"), "batch_id", "left_semi")
    return out.where(F.col("type").isin(types)) if types is not None else out


def decode(log: DataFrame, schema: str | T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Events with their payload's fields: those that a payload lacks are null or the default, those not in the schema are left out."""
    shape = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    event = F.from_json("payload", shape)
    fields = [F.coalesce(event[f.name], F.lit((defaults or {}).get(f.name)).cast(f.dataType)).alias(f.name) for f in shape]
    return log.select("batch_id", "seq", "type", *fields)


def read_new(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hands over what was appended since the last call with this checkpoint, then returns."""
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def with_type(data: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of a data log with the names of their types from a metadata log, and the events whose type has not arrived yet."""
    return data.join(types, "type_id"), data.join(types, "type_id", "left_anti")
