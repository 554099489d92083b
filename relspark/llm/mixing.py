"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's documents are put in an order drawn by hash and cut into blocks of BLOCK documents. A
source of weight n among weights that sum to L is due n blocks in every L slots: its block k is
released at slot floor(k L / n) and has its deadline at ceil((k + 1) L / n). The slots take the
released block with the earliest deadline, so at any slot each source has had its share to within
less than one block. The schedule repeats after L slots; when a source has run out, the others go on
with theirs. So the plan is a few rows for each source, found on the driver from the sources' block
counts, and each document's place follows by arithmetic. No document is dropped or repeated.

Numbering a source's documents takes no task that holds a whole source: rows are dealt by source and
a range of their hash, about PART_ROWS together, numbered there, and moved up by the counts of the earlier parts.

A null source is a source of its own; a null doc_id is an id like any other. Sources without a weight
have DEFAULT_WEIGHT. At most MAX_SOURCES sources, with weights that sum to MAX_SUM or less when divided by
what they have in common: the plan is made on the driver and has at most the square of their number in rows. It is broadcast up to
MAX_SENT slots and joined by shuffle beyond. Repeated rows get a place each; an empty table gives an empty
one; columns of the input that bear the names of those added are replaced, and any other name may occur.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 100
PART_ROWS = 4000
DEFAULT_WEIGHT = 1
MAX_SOURCES, MAX_SUM, MAX_SENT = 2000, 1_000_000, 2_000_000
#: Target weights of the query and the pipeline: src0 at twice, src1 to src4 at one and a half times the others.
WEIGHTS = {"src0": 4, "src1": 3, "src2": 3, "src3": 3, "src4": 3}
DEFAULT_OTHERS = 2
ADDED = ["block", "slot", "release", "deadline", "mix_position"]


def earliest_deadline_first(weights: dict[str, int], most: int | None = None) -> dict[str, list[int]]:
    """The slots of each source's blocks in one period, which has as many slots as the weights sum to (or in its first slots, most)."""
    total = sum(weights.values())
    due: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s) for s in weights]  # by release
    ready: list[tuple[int, str]] = []  # by deadline
    heapq.heapify(waiting)
    for slot in range(total if most is None else min(most, total)):
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(due[s]) + 1) * total // weights[s]), s))
        _, s = heapq.heappop(ready)
        due[s].append(slot)
        if len(due[s]) < weights[s]:
            heapq.heappush(waiting, (len(due[s]) * total // weights[s], s))
    return due


def plan(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple]:
    """Rows (source, first block, last block, first slot, period, blocks of a period, slots of the blocks) of each phase; a phase ends when a source does."""
    rows, left, done, base = [], {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0
    while left:
        some = math.gcd(*(weights[s] for s in left))
        now = {s: weights[s] // some for s in sorted(left)}
        period = sum(now.values())
        slots = earliest_deadline_first(now, sum(left.values()))
        # The first to run out: where its last block stands. A source whose last block is past the slots made has not run out in them.
        end = min((n - 1) // now[s] * period + slots[s][(n - 1) % now[s]] for s, n in left.items() if (n - 1) % now[s] < len(slots[s])) + 1
        for s in list(left):
            used = end // period * now[s] + sum(x < end % period for x in slots[s])
            if used:
                rows.append((s, done[s], done[s] + used - 1, base, period, now[s], slots[s][:used]))
            done[s] += used
            left[s] -= used
            if not left[s]:
                del left[s]
        base += end
    return rows


def _order(docs: DataFrame, key: str) -> list[Column]:
    """A drawn order that depends on the rows alone; equal rows are interchangeable."""
    return [F.xxhash64(F.lit(17), F.col(key)), F.col(key), *(F.xxhash64(c) for c in docs.columns if c != key and docs.schema[c].dataType.typeName() not in ("map", "variant"))]


def mix(docs: DataFrame, weights: dict[str, int], default: int = DEFAULT_WEIGHT, block: int = BLOCK, source: str = "source", key: str = "doc_id") -> DataFrame:
    """All rows and columns, with block (of its source), slot, release, deadline and mix_position (the place in the mix) long."""
    docs = docs.drop(*ADDED)
    spark = docs.sparkSession
    of = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))
    counts = docs.groupBy(of.alias("of")).count().limit(MAX_SOURCES + 1).collect()  # refused below if there are more
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = {r["of"]: r["count"] for r in counts}
    given = {s: weights.get(s[1:], default) if s != "null" else default for s in rows}
    if any(w < 1 for w in given.values()) or sum(given.values()) > MAX_SUM * math.gcd(*given.values()):
        raise ValueError(f"weights are to be positive integers that sum to {MAX_SUM} or less when divided by what they have in common")
    parts = F.create_map(*(F.lit(x) for s, n in rows.items() for x in (s, -(-n // PART_ROWS)))) if rows else F.lit(None).cast("map<string,int>")
    hashed, *ties = _order(docs, key)
    named = docs.select(F.struct(*docs.columns).alias("row"), of.alias("of"), hashed.alias("hash"), *(x.alias(f"tie{k}") for k, x in enumerate(ties)))
    parted = named.withColumn("part", F.shiftright(F.shiftrightunsigned("hash", 33) * F.element_at(parts, F.col("of")), 31))
    before = parted.groupBy("of", "part").count().select("of", "part", (F.sum("count").over(Window.partitionBy("of").orderBy("part")) - F.col("count")).alias("before"))
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("of", "part").orderBy("hash", *(f"tie{k}" for k in range(len(ties))))) - 1)
    placed = ranked.join(before, ["of", "part"]).select("row", "of", (F.col("before") + F.col("rank")).alias("at")).withColumn("block", F.floor(F.col("at") / block))
    phases = plan({s: -(-n // block) for s, n in rows.items()}, given)
    shape = "of string, first long, last long, base long, period long, n long, slots array<long>"
    table = spark.createDataFrame(phases, shape)
    if sum(len(p[-1]) for p in phases) <= MAX_SENT:
        table = F.broadcast(table)
    due = placed.join(table, "of").where("block between first and last")
    k, n = F.col("block") - F.col("first"), F.col("n")
    slot = F.expr("base + (block - first) div n * period + slots[int((block - first) % n)]")
    out = due.withColumns({"slot": slot, "release": F.col("base") + F.floor(k * F.col("period") / n), "deadline": F.col("base") + F.ceil((k + 1) * F.col("period") / n)})
    return out.withColumn("mix_position", F.col("slot") * block + F.col("at") % block).select("row.*", *ADDED)


def in_order(mixed: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows dealt and sorted so that files read one after another give the mix."""
    return (mixed.repartitionByRange(parts, "mix_position") if parts else mixed.repartitionByRange("mix_position")).sortWithinPartitions("mix_position")


def places(docs: DataFrame, to: str = "mix_position") -> DataFrame:
    """All rows and columns of a table read from Parquet files that in_order() dealt, with each row's place in the mix (from 0, without gaps).

    Readers pack files by size and split large ones, so the order of the files' names and of the rows in them is
    what tells the places. Of rows that come from no file, the order is that of the partitions.
    """
    docs = docs.drop(to)
    at = ["_metadata.file_path", "_metadata.row_index"] if docs.inputFiles() else [F.lit("").alias("file_path"), F.monotonically_increasing_id().alias("row_index")]
    found = docs.select(F.struct(*docs.columns).alias("row"), *at)
    if not docs.inputFiles():
        found = found.withColumns({"file_path": F.lpad(F.shiftright("row_index", 33).cast("string"), 10, "0"), "row_index": F.col("row_index").bitwiseAND(F.lit((1 << 33) - 1))})
    by_number = Window.orderBy(F.regexp_extract("file_path", r"part-(\d+)[^/]*$", 1).try_cast("long"), "file_path")
    files = found.groupBy("file_path").count().select("file_path", (F.sum("count").over(by_number) - F.col("count")).alias("before"))  # a row for each file
    return found.join(files, "file_path").withColumn(to, F.col("before") + F.col("row_index")).select("row.*", to)


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source"), WEIGHTS, DEFAULT_OTHERS)
