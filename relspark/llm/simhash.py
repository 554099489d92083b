"""SimHash near-duplicates: a grid range-join on segment popcounts, verified exactly.

A fingerprint's 64 bits are cut into 32 segments and mapped to the segments' bit counts. Manhattan
distance between these vectors is at most the Hamming distance between the fingerprints, so links
at 2 bits or fewer are to be found among vectors at distance 2 or less; and two such vectors have a
vector within 1 of both. Every distinct fingerprint therefore goes to its own cell of the grid and
to those one step away (49 on average), and linked fingerprints meet in a cell. Cells are first
only counted, with their least and greatest member, so what is shuffled is pre-aggregated:

* a cell with one member holds no pair;
* a cell with two is verified at once, by the Hamming distance of the two;
* in a cell with more, each member names the fingerprints one bit away that lie in this very cell
  (or itself, in its own cell). Members linked at 2 bits name a common one, and members that name a
  common one are linked; 65 at most can do so, so a star from the least of them carries all links.

All of it grows with the number of distinct fingerprints, however many near copies there are; equal
fingerprints are one. Components of the links come from contraction (graph.py).

Texts: A-Z in lower case, words joined by a space, shingles with repeats; with fewer words than a
shingle has, the whole sequence is one; without words (or with a null text) the fingerprint is zero
and is linked like any other. A null doc_id belongs to a component like any other, and names one only where all its
ids are null; repeated rows have one class; an empty table gives an empty one. Texts are read whole, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.llm.common import Words, dropped, per_slice, written
from relspark.llm.graph import components

SEED = 42
SEGMENTS = 32
LOW = 0x5555555555555555


def fingerprints_of(texts: pa.Array, shingle: int) -> np.ndarray:
    """Fingerprints of a column of texts, unsigned."""
    w = Words(texts, lower=True)
    keep = np.zeros(len(w.buf) + 1, np.int8)
    keep[w.start] += 1
    np.subtract.at(keep, np.minimum(w.end + 1, len(w.buf)), 1)  # a word and the one separator after it
    joined = w.buf[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
    size = w.end - w.start
    start = np.cumsum(size + 1) - size - 1
    joined[start + size] = 32
    data, end = joined.tobytes(), start + size
    n = np.where(w.count >= shingle, w.count - shingle + 1, np.minimum(w.count, 1))
    row = np.repeat(np.arange(len(n)), n)
    first = w.first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    last = first + np.minimum(shingle, w.count[row]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(data[a:b], SEED) for a, b in zip(start[first].tolist(), end[last].tolist())], "<u8")
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def simhash(docs: DataFrame, shingle: int = 5, text: str = "text", to: str = "fp") -> DataFrame:
    """All columns but the text, with the fingerprint as a signed long."""
    docs = docs.drop(to)
    others = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(to, T.LongType())])

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = pa.array(fingerprints_of(batch.column(text), shingle).view(np.int64))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), fp], names=[*others, to])

    return docs.mapInArrow(per_slice(make, text), schema)


def popcounts(fp: Column) -> Column:
    """The bit counts of the segments (0 to 2), two bits each, as one long."""
    low, half = F.lit(LOW), F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseXOR(half).bitwiseAND(low))


def _steps(vector: Column) -> Column:
    """Cells one step away, with the segment stepped in."""
    at = F.sequence(F.lit(0), F.lit(SEGMENTS - 1))
    count = lambda i: F.call_function("shiftrightunsigned", vector, (2 * i).cast("int")).bitwiseAND(F.lit(3))
    step = lambda i, x: F.struct(vector.bitwiseXOR(F.call_function("shiftleft", F.lit(x).cast("long"), (2 * i).cast("int"))).alias("cell"), i.cast("int").alias("segment"))
    one = F.transform(F.filter(at, lambda i: count(i) <= 1), lambda i: step(i, 1))
    three = F.transform(F.filter(at, lambda i: count(i) >= 1), lambda i: step(i, 3))
    return F.concat(F.array(F.struct(vector.alias("cell"), F.lit(-1).alias("segment"))), one, three)


def links(fingerprints: DataFrame) -> DataFrame:
    """u, v: pairs that connect all of the distinct fingerprints fp linked at 2 or fewer differing bits."""
    placed = fingerprints.select("fp", F.explode(_steps(popcounts(F.col("fp")))).alias("at")).select("fp", "at.cell", "at.segment")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    cells = written(cells)
    pairs = cells.where("n = 2 and bit_count(u ^ v) <= 2").select("u", "v")
    crowded = placed.join(cells.where("n > 2").select("cell"), "cell")
    flips = F.array(*(F.call_function("shiftleft", F.lit(x).cast("long"), F.col("segment") * 2) for x in (1, 2)))
    named = F.when(F.col("segment") < 0, F.array("fp")).otherwise(F.filter(F.transform(flips, lambda b: F.col("fp").bitwiseXOR(b)), lambda w: popcounts(w) == F.col("cell")))
    met = crowded.select("fp", F.explode(named).alias("named"))
    least = met.groupBy("named").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("all")).where("size(all) > 1")  # 65 at most
    stars = least.select("u", F.explode("all").alias("v")).where("u <> v")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, shingle: int = 5, text: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that links at 2 or fewer differing bits reach, itself included."""
    found = written(simhash(docs.select("doc_id", text), shingle, text))
    one = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = components(links(one)).select(F.col("node").alias("fp"), "component")
    linked = one.join(parts, "fp")
    label = linked.groupBy("component").agg(F.min("least").alias("label"))
    # Written, so that both sides of the last join come from a shuffle of their own, whose hot keys Spark can split.
    labels = written(one.join(linked.join(label, "component").select("fp", "label"), "fp", "left").select("fp", F.coalesce("label", "least").alias("component_id")))
    dropped(one)
    return found.join(labels, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, 3).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
