"""Substring dedup by fixed-block anchors.

A window of WINDOW words that occurs twice holds, in its first place, a whole block of BLOCK words
that starts at a multiple of BLOCK there. So these non-overlapping blocks are the index, every
rolling run of BLOCK words is a probe, and both meet in buckets of their hash (pass 1). Where a probe
hits a block, the windows over it are candidates; their hashes meet in the same way, and each finds
the first place of its sequence (pass 2). Runs of windows that start earlier elsewhere are the
maximal exact repeats; their words are cut.

Both passes send packed rows: a task sums up a slice of documents as one row for each bucket, with
each hash once (so a passage in a third of all documents makes one entry a slice, not one for each
document), and keeps the repeats within the slice in a row of its own. What a bucket finds goes back
to the slice's row, and from there one row for each document to the documents. The number of buckets
follows the number of characters, so a bucket takes about BUCKET_CHARS of text at any size.

Hashes: pass 1 tells probes apart by the bucket and 32 bits (a wrong hit only makes a candidate);
pass 2 by a bucket and 64 bits of two independent functions. Places are ordered by doc_id (null
first), then by a hash of the text, then by word; rows of one doc_id with equal texts are the same
place, and none of them counts as earlier. Nulls count as empty texts. Fewer than WINDOW words: nothing to cut.
Texts of any length are read whole; an empty table gives an empty one; columns of the input that bear the names of
those added are replaced, and any other name may occur.

A slice is numbered by its task and its place in it, so its rows must come in the same order when a task is run
again: in pass 1 they come as the files of docs have them (write() other inputs first), in pass 2 sorted by place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.llm.common import SCAN_BYTES, Words, release, rolling, slices, written

WINDOW, BLOCK = 20, 10
BUCKET_CHARS = 8 << 20
NO_ID = -(1 << 63)
PACKED = "bucket long, slice long, key binary, at binary, flag binary, id binary, th binary, first binary, rep binary, follower binary"
FOUND = "slice long, at binary, id binary, th binary, first binary, rep binary, follower binary"
_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(x: np.ndarray) -> bytes:
    """The array's bytes by significance, compressed, behind their length."""
    raw = np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).T).tobytes() if len(x) else b""
    return len(raw).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def unpack(data: bytes | None, kind: str) -> np.ndarray:
    n = int.from_bytes(data[:8], "little") if data else 0
    if not n:
        return np.zeros(0, kind)
    raw = np.frombuffer(_ZSTD.decompress(data[8:], n, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def deltas(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def summed(data: bytes | None, kind: str = "<u4") -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def _sorted_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices with their rows by id and th, each id and th once, and a number that is the same whenever the task is run."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, "_text"):
            order = pc.sort_indices(part, [("_id", "ascending"), ("_th", "ascending")])
            part = part.take(order)
            ids, ths = (part.column(c).to_numpy() for c in ("_id", "_th"))
            yield number, part.filter(pa.array(np.concatenate([[True], (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])])))
            number += 1


def _exchange(docs: DataFrame, entries: Callable, buckets: int, wide: bool) -> DataFrame:
    """_id, _th, _at binary: for each document the words at which entries() met an entry elsewhere.

    entries: from a slice and its words, the words at which entries start (ascending), their keys, and
    flags. wide: keys are of 64 bits, and only those met that another came before; else of 32, and those
    of which one has its flag set and that are two or more.
    """
    kind = "<u8" if wide else "<u4"
    high = 64 - max(1, (buckets - 1).bit_length())

    def send(batches):
        for number, part in _sorted_slices(batches):
            w = Words(part.column("_text"))
            at, key, place, flag = entries(part, w)
            _, rep, same = np.unique(key, return_index=True, return_inverse=True)  # the first of each
            follows = rep[same] != np.arange(len(key))
            several = np.zeros(len(rep), np.uint8)
            several[same[follows]] = 2
            flagged = np.zeros(len(rep), np.uint8)
            flagged[same[flag]] = 1
            bucket = (place[rep] >> np.uint64(high)).astype(np.int64)
            order = np.lexsort((rep, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(int(bucket.max(initial=0)) + 2))
            ids, ths = (part.column(c).to_numpy().astype(np.int64) for c in ("_id", "_th"))
            rows: dict[str, list] = {c.split()[0]: [] for c in PACKED.split(", ")}

            def put(**x):
                for c, col in rows.items():
                    col.append(x.get(c))

            for b, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if hi > lo:
                    mine = order[lo:hi]
                    more = {}
                    if wide:
                        row = w.row[at[rep[mine]]]
                        more = {"id": deltas(ids[row]), "th": pack(ths[row]), "first": pack((at[rep[mine]] - w.first[row]).astype("<u4"))}
                    put(bucket=b, slice=number, key=pack(key[rep[mine]].astype(kind)) if not wide else key[rep[mine]].astype(kind).tobytes(), at=deltas(at[rep[mine]].astype("<u4")), flag=pack((several | flagged)[mine]), **more)
            put(bucket=-1 - number, slice=number, id=pack(ids), th=pack(ths), first=pack(w.first.astype("<u4")), rep=pack(at[rep[same[follows]]].astype("<u4")), follower=deltas(at[follows].astype("<u4")))
            yield pa.RecordBatch.from_pydict(rows, schema=arrow)
        release()

    arrow = pa.schema([pa.field(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in PACKED.split(", ")])
    back = pa.schema([pa.field(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in FOUND.split(", ")])

    def meet(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        if rows["bucket"][0] < 0:  # a slice's own row
            return group.select(back.names).cast(back)
        keys = [np.frombuffer(k, kind) if wide else unpack(k, kind) for k in rows["key"]]
        size = [len(k) for k in keys]
        key, flag = np.concatenate(keys), np.concatenate([unpack(f, "u1") for f in rows["flag"]])
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        group_of = np.empty(len(key), np.int64)
        group_of[order] = np.cumsum(new) - 1
        if wide:
            many = np.bincount(group_of)[group_of] > 1
            met = np.zeros(len(key), bool)
            if many.any():
                some = np.flatnonzero(many)
                where = [np.concatenate([f(x) for x in rows[c]])[some] for c, f in (("first", lambda x: unpack(x, "<u4")), ("th", lambda x: unpack(x, "<i8")), ("id", lambda x: summed(x, "<i8")))]
                by = np.lexsort((*where, group_of[some]))
                g = group_of[some][by]
                least = np.concatenate([[True], g[1:] != g[:-1]])
                head = np.flatnonzero(least)[np.cumsum(least) - 1]
                equal = np.logical_and.reduce([x[by] == x[by][head] for x in where])
                met[some[by[~equal]]] = True
        else:
            weight = np.bincount(group_of, weights=1 + (flag >> 1))
            good = (weight > 1) & (np.bincount(group_of, weights=flag & 1) > 0)
            met = good[group_of]
        out, start = {c: [] for c in back.names}, 0
        for k, n in enumerate(size):
            hit = met[start : start + n]
            if hit.any():
                for c in out:
                    out[c].append(None)
                out["slice"][-1], out["at"][-1] = rows["slice"][k], deltas(summed(rows["at"][k])[hit])
            start += n
        return pa.table(out, schema=back)

    def gather(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        own = next(k for k, x in enumerate(rows["first"]) if x is not None)
        hits = [summed(x) for x in rows["at"] if x is not None]
        rep, follower = unpack(rows["rep"][own], "<u4"), summed(rows["follower"][own])
        found = np.concatenate([np.zeros(0, "<u4"), *hits])
        found = np.unique(np.concatenate([found, follower if wide else follower[np.isin(rep, found)]]))
        first, ids, ths = unpack(rows["first"][own], "<u4"), unpack(rows["id"][own], "<i8"), unpack(rows["th"][own], "<i8")
        cuts = np.searchsorted(found, first)
        out = [(i, t, deltas(found[a:b] - f)) for i, t, f, a, b in zip(ids.tolist(), ths.tolist(), first, cuts[:-1].tolist(), cuts[1:].tolist()) if b > a]
        return pa.table({"_id": pa.array([x[0] for x in out], pa.int64()), "_th": pa.array([x[1] for x in out], pa.int64()), "_at": pa.array([x[2] for x in out], pa.binary())})

    met = docs.mapInArrow(send, PACKED).groupBy("bucket").applyInArrow(meet, FOUND)
    return met.groupBy("slice").applyInArrow(gather, "_id long, _th long, _at binary")


def _runs(w: Words, n: int) -> np.ndarray:
    """Words at which n words of one document start."""
    m = max(0, len(w.start) - n + 1)
    return np.flatnonzero(w.row[:m] == w.row[n - 1 : n - 1 + m])


def _anchors(block: int) -> Callable:
    def entries(part: pa.RecordBatch, w: Words) -> tuple:
        at = _runs(w, block)
        key = rolling(w.hashes(), block)[at]
        return at, key & np.uint64(0xFFFFFFFF), key, (at - w.first[w.row[at]]) % block == 0

    return entries


def _windows(window: int, block: int) -> Callable:
    def entries(part: pa.RecordBatch, w: Words) -> tuple:
        near = np.zeros(len(w.start) + 1, np.int64)
        for row, hits in enumerate(part.column("_hits").to_pylist()):
            if hits:
                at = summed(hits).astype(np.int64)
                a, b = w.first[row], w.first[row + 1]
                np.add.at(near, a + np.maximum(at - (window - block), 0), 1)
                np.add.at(near, np.minimum(a + at + 1, b), -1)
        at = _runs(w, window)
        at = at[np.cumsum(near)[at] > 0]
        return at, rolling(w.hashes(), window)[at], rolling(w.hashes(which=1), window, 1)[at], np.zeros(len(at), bool)

    return entries


def substring_dedup(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, digests: bool = False, text: str = "text") -> DataFrame:
    """All rows and columns with n_words and n_removed long, and the text without the words of repeated windows
    (each goes with the white space after it). digests: instead of the text kept_sha256, of the kept words joined by a space."""
    if 2 * block > window + 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    added = ["n_words", "n_removed", *["kept_sha256"] * digests]
    docs = docs.drop(*added)
    others = [c for c in docs.columns if c != text]
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = max(32, 1 << (chars // BUCKET_CHARS).bit_length())
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"), F.struct(*others).alias("_row"))
    slim = keyed.select("_id", "_th", "_text")
    hits = written(_exchange(slim, _anchors(block), buckets, False).groupBy("_id", "_th").agg(F.first("_at").alias("_hits")))
    # Both joins read all columns of the documents, so that one shuffle of them serves both.
    near = keyed.join(hits.hint("shuffle_hash"), ["_id", "_th"]).sortWithinPartitions("_id", "_th")
    cut = _exchange(near, _windows(window, block), buckets, True).groupBy("_id", "_th").agg(F.first("_at").alias("_cut"))
    whole = keyed.join(cut.hint("shuffle_hash"), ["_id", "_th"], "left")
    results = [*[T.StructField(text, T.StringType())] * (not digests), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), *[T.StructField("kept_sha256", T.StringType())] * digests]
    schema = T.StructType([keyed.schema["_row"], *(T.StructField(f"_{k}", f.dataType) for k, f in enumerate(results))])

    def finish(batches):
        for batch in batches:
            for part in slices(batch, "_text", SCAN_BYTES):
                w = Words(part.column("_text"))
                gone = np.zeros(len(w.start) + 1, np.int64)
                for row, at in enumerate(part.column("_cut").to_pylist()):
                    if at:
                        at = summed(at).astype(np.int64) + w.first[row]
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                removed = np.bincount(w.row, weights=gone, minlength=part.num_rows).astype(np.int64)
                if digests:
                    out, data = [], w.buf.tobytes()
                    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                        kept = np.flatnonzero(~gone[a:b]) + a
                        out.append(hashlib.sha256(b" ".join([data[s:e] for s, e in zip(w.start[kept].tolist(), w.end[kept].tolist())])).hexdigest())
                else:
                    out = part.column("_text").to_pylist()
                    after = np.append(w.start[1:], len(w.buf))
                    for row in np.flatnonzero(removed).tolist():
                        a, b, end = w.first[row], w.first[row + 1], w.at[row + 1] - 1
                        keep = np.ones(end - w.at[row], bool)
                        for k in np.flatnonzero(gone[a:b]) + a:
                            keep[w.start[k] - w.at[row] : min(after[k], end) - w.at[row]] = False
                        out[row] = w.buf[w.at[row] : end][keep].tobytes().decode()
                cols = [part.column("_row"), *[pa.array(out, pa.string())] * (not digests), pa.array(w.count.astype(np.int64)), pa.array(removed), *[pa.array(out, pa.string())] * digests]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        release()

    done = whole.drop("_id", "_th").mapInArrow(finish, schema).select("_row.*", *(F.col(f"_{k}").alias(f.name) for k, f in enumerate(results)))
    return done if digests else done.select(*docs.columns, "n_words", "n_removed")


def digest(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs.select("doc_id", "text"), digests=True)
