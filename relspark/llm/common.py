"""Helpers shared by the operators: tables in the shared folder and vectorised word scanning.

A word is a maximal run of bytes that are neither a space nor one of 0x09-0x0D. All scanning works
on the UTF-8 bytes of an Arrow column at once, so a task holds one slice of a batch and no more.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES, SCAN_BYTES = 2 << 20, 1 << 18
"""Bytes of text packed as one row, and bytes scanned at once where rows are judged alone; one longer text is scanned alone."""

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64


_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local folder serves a local master (tests); any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("relspark.test.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("relspark.test.dir", base)
    return f"{base.rstrip('/')}/relspark/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: a stage boundary that survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[table] = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Empties written tables that nothing reads any more."""
    for table in tables:
        if path := _tables.pop(table, None):
            table.sparkSession.createDataFrame([], table.schema).coalesce(1).write.mode("overwrite").parquet(path)


def slices(batch: pa.RecordBatch, column: str = "text", least: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts together take about so many bytes."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(size) // least
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(32)
    x *= _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n + n // 4, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_BYTES = [mix(np.arange(1, 257, dtype=np.uint64) * _U(k)) | _U(1) for k in (0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)]
_POWERS = [Powers(0x5851F42D4C957F2D), Powers(0xDA942042E4DD58B5)]
_STEPS = [Powers(0xC6BC279692B5CC83), Powers(0x8CB92BA72F3D8DD7)]


class Words:
    """The words of a column of texts (null: empty), in order.

    start, end: byte ranges in buf; first: index of each row's first word, and the total at the end.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, separators: np.ndarray = SPACE):
        texts = pc.cast(texts, pa.large_string())
        texts = pc.binary_join_element_wise(pc.fill_null(texts, ""), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
        self.at = at - at[0]
        if lower:
            self.buf = LOWER[self.buf]
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[:-1] = ~separators[self.buf]
        step = np.diff(inside, prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None, which: int = 0) -> np.ndarray:
        """64-bit hashes of byte ranges (the words, if none are given); which: one of two independent functions."""
        start, end = (self.start, self.end) if start is None else (start, end)
        up, down = _POWERS[which].to(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_BYTES[which][self.buf] * up[:-1], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))

    def text(self, k: int) -> bytes:
        return self.buf[self.start[k] : self.end[k]].tobytes()


def release() -> None:
    """Gives memory back at the end of a task: workers live on, and an idle one should be small."""
    for powers in (*_POWERS, *_STEPS):
        powers.up = powers.down = np.ones(1, np.uint64)
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def rolling(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of every n consecutive entries; shorter by n - 1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = _STEPS[which].to(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])


def per_slice(make: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text") -> Callable:
    """A function for mapInArrow that applies make to each slice."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, SCAN_BYTES):
                if (out := make(part)) is not None and out.num_rows:
                    yield out
        release()

    return run
