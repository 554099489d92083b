"""Near-duplicate removal for a pipeline: one document of each group of copies stays.

Documents are copies of each other where the Jaccard similarity of their sets of five-word shingles
is SIMILAR or more. Fingerprints at 2 bits (simhash.py) meet only copies that are all but equal: near
copies at 0.8 to 0.9 were measured 4 to 14 bits apart. So candidate groups come from two sources: the
stars of linked fingerprints, and equal fingerprints of SAMPLES samples, each of the WIDE shingles that
come first in an order of its own (a pair at 0.8 is missed by all with a chance of 8 in 100,000, one at
0.85 of 2 in a million). Sets of fewer than FEW shingles take samples of NARROW, and those near that size both, so that
any two sets that may be similar have samples of one kind. Similar to one member says nothing of another, so no star stands for a group: every
pair in a group is verified on the whole shingle sets, unless its ends are joined already or their sizes, their rare
shingles or their sketches alone rule it out (_joined). Sizes and rare shingles give exact bounds: two texts that share no
shingle of those that at most RARE texts have cannot share more than the rest of the smaller rest; those that do share one are
few, and verified at once (_rare). A sketch is a bit of each of 256 least hashes; those of a pair at 0.8 differ in 26 bits on average, and in more than FAR with a chance of 1 in 1,000 (at 0.85: 2 in a million). Components of what holds are the groups of copies.

Equal word sequences are one text from the start. Nulls count as empty texts; texts without words are
copies of each other. Rows without a doc_id stay; rows of one doc_id count as one document, of which
the least text stays. Texts are read whole, however long; an empty table gives an empty one; other columns may bear any name.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import Words, dropped, mix, per_slice, release, rolling, written
from relspark.llm.graph import components
from relspark.llm.simhash import fingerprints_of, links

SHINGLE, SIMILAR = 5, 0.8
SAMPLES, WIDE, NARROW, FEW = 40, 7, 4, 32
ONE_LEADER = 3
"""Rounds in which only the foremost lead; later ones draw more."""
RARE = 8
"""Texts that share a shingle which so many of those left have, or fewer, are verified pair by pair."""
FAR = 40
SKETCH = ["s0", "s1", "s2", "s3"]
MARKS = "doc_id long, t1 long, t2 long, fp long, bands array<long>"
SETS = "doc_id long, shingles binary, " + ", ".join(f"{c} long" for c in SKETCH)
_TURNS = mix(np.arange(1000, 1256, dtype=np.uint64)) | np.uint64(1)


def _shingles(w: Words, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles (of a shorter text: of all its words) and their rows."""
    h = w.hashes(which=which)
    n = max(0, len(h) - SHINGLE + 1)
    at = np.flatnonzero(w.row[:n] == w.row[SHINGLE - 1 : SHINGLE - 1 + n])
    key, row = rolling(h, SHINGLE, which)[at], w.row[at]
    short = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
    if len(short):
        rest = np.array([np.bitwise_xor.reduce(mix(h[w.first[r] : w.first[r + 1]] + np.arange(w.count[r], dtype=np.uint64))) for r in short.tolist()], np.uint64)
        key, row = np.concatenate([key, rest]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        key, row = key[order], row[order]
    return key, row


def _mark(batch: pa.RecordBatch) -> pa.RecordBatch:
    w = Words(batch.column("text"), lower=True)
    n = batch.num_rows
    sums = []
    for which in (0, 1):  # of the whole word sequence
        h = mix(w.hashes(which=which) + mix(np.arange(len(w.row), dtype=np.uint64) - w.first[w.row].astype(np.uint64)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
        sums.append(total[w.first[1:]] - total[w.first[:-1]])
    key, row = _shingles(w)
    cuts = np.searchsorted(row, np.arange(n + 1)).tolist()
    seeds = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))
    bands: list[np.ndarray] = []
    for k in range(n):
        own = np.unique(key[cuts[k] : cuts[k + 1]])
        order = mix(own[None, :] ^ seeds[:, None])
        first = lambda r: (np.partition(order, r - 1, axis=1)[:, :r] if len(own) > r else order).sum(axis=1, dtype=np.uint64)  # noqa: B023, E731
        kinds = [first(NARROW) + seeds] * (len(own) < FEW) + [first(WIDE) ^ ~seeds] * (len(own) >= SIMILAR * FEW - 2)
        bands.append(np.concatenate(kinds))
    size = np.cumsum([0, *map(len, bands)]).astype(np.int32)
    fp = fingerprints_of(batch.column("text"), SHINGLE)
    lists = pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate(bands).view(np.int64)))
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(x.view(np.int64)) for x in (*sums, fp)), lists], names=["doc_id", "t1", "t2", "fp", "bands"])


def sketch(own: np.ndarray) -> np.ndarray:
    """A bit of the least of a set's hashes under each of 256 functions, as four longs."""
    if not len(own):
        return np.zeros(len(SKETCH), np.int64)
    least = np.stack([(part[None, :] * _TURNS[:, None]).min(axis=1) for part in np.array_split(own, len(own) // 2048 + 1)]).min(axis=0)
    return np.packbits((least >> np.uint64(20)).astype(np.uint8) & 1).view(np.int64)


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    w = Words(batch.column("text"), lower=True)
    key, row = _shingles(w)
    cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
    own = [np.unique(key[a:b]) for a, b in zip(cuts, cuts[1:])]
    sketches = np.stack([sketch(x) for x in own], axis=1)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([x.tobytes() for x in own], pa.binary()), *map(pa.array, sketches)], names=["doc_id", "shingles", *SKETCH])


def _views(column: pa.Array) -> list[np.ndarray]:
    """The sets of a binary column, without copies."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    return [np.frombuffer(data, np.uint64, (b - a) // 8, a) if b > a else np.zeros(0, np.uint64) for a, b in zip(at, at[1:])]


def _similar(batches):
    for batch in batches:
        good = []
        for x, y in zip(_views(batch.column("a")), _views(batch.column("b"))):
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(both >= SIMILAR * (len(x) + len(y) - both))
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))
    release()


def _each(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            own = _views(part.column("shingles"))
            rep = np.repeat(part.column("rep").to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.concatenate(own).view(np.int64))], names=["rep", "shingle"])
    release()


def _rare(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rep, n: how many of each set's shingles at most RARE of the sets have; and u < v: the pairs of sets that share one of them."""
    each = sets.select("rep", "shingles").mapInArrow(_each, "rep long, shingle long")
    few = written(each.join(each.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") <= RARE), "shingle"))
    met = few.where("n > 1").groupBy("shingle").agg(F.collect_list("rep").alias("reps")).select("reps", F.explode("reps").alias("u"))
    pairs = met.select("u", F.explode(F.filter("reps", lambda v: v > F.col("u"))).alias("v")).distinct()
    return few.groupBy("rep").agg(F.count("*").alias("n")), pairs


def _grouped(texts: DataFrame) -> DataFrame:
    """key, rep, n, weight: the members of each candidate group of two or more, the group's size, and the sum of the sizes of a member's groups."""
    stars = written(links(texts.select("fp").distinct()))
    around = stars.select(F.col("u").alias("at"), F.col("v").alias("fp")).union(stars.select("u", "u")).union(texts.select("fp", "fp")).distinct()
    by_print = texts.select("fp", "rep").join(around, "fp").select(F.xxhash64(F.lit(-1), "at").alias("key"), "rep")
    by_band = texts.select("rep", F.explode("bands").alias("key"))
    members = written(by_print.union(by_band.select("key", "rep")).distinct())
    several = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = written(members.join(several, "key"))
    weighed = written(found.join(found.groupBy("rep").agg(F.sum("n").alias("weight")), "rep"))
    dropped(members, found, stars)
    return weighed


def _led(live: DataFrame, sets: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """rep: the leaders of a round; and u < v: the pairs of a leader and a member of its groups that are to be verified."""
    drawn = F.pmod(F.xxhash64(F.lit(k), F.lit("draw"), "rep"), F.lit(1 << 30)) < F.lit(2.0 * 4 ** (k - ONE_LEADER - 1) * (1 << 30) if k > ONE_LEADER else 0.0) / F.col("left")
    met = live.groupBy("rep").agg(F.min("foremost")["leader"].alias("leader"), F.max(drawn).alias("drawn"))
    leaders = written(met.where("leader = rep or drawn").select("rep"))
    sketched = lambda df, to: df.join(sets.select("rep", *(F.col(c).alias(f"{to}{c}") for c in SKETCH)), "rep").withColumnRenamed("rep", to)
    ahead = sketched(live.join(leaders, "rep").select("key", "rep", F.col("component").alias("cu"), F.col("size").alias("su"), F.col("common").alias("mu")), "u")
    by_key = ahead.groupBy("key").agg(F.collect_list(F.struct("u", "cu", "su", "mu", *(f"u{c}" for c in SKETCH))).alias("leaders"))
    facing = sketched(live.select("key", "rep", F.col("component").alias("cv"), F.col("size").alias("sv"), F.col("common").alias("mv")).join(by_key.select("key"), "key", "left_semi"), "v")

    def near(u: Column) -> Column:
        far = sum((F.bit_count(u[f"u{c}"].bitwiseXOR(F.col(f"v{c}"))) for c in SKETCH), F.lit(0))
        both = F.least(u["mu"], F.col("mv"))  # at most
        return (u["cu"] != F.col("cv")) & (both >= SIMILAR * (u["su"] + F.col("sv") - both)) & (far <= FAR)

    # A pair may share many groups: of each member, the leaders to be verified against are gathered before there is a row for each.
    some = facing.join(by_key, "key").select("v", F.transform(F.filter("leaders", near), lambda u: u["u"]).alias("us")).where("size(us) > 0")
    apart = some.groupBy("v").agg(F.array_distinct(F.flatten(F.collect_list("us"))).alias("us")).select("v", F.explode("us").alias("u"))
    pairs = written(apart.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    return leaders, pairs


def _joined(members: DataFrame, sets: DataFrame) -> DataFrame:
    """rep, component: the components of all similar pairs that share a candidate group.

    In a round some members of open groups lead: those that no member of any of their groups comes before (in the order of
    how often they are met in all), so that a cluster of copies has one leader whatever its groups; and after
    ONE_LEADER rounds also about 2, 8, 32 ... of each group at random.
    A leader is verified against each member of its groups that is of another component and has not led. So of each
    pair in a group, either one has led while they were apart, and the pair was verified, or they are in one component
    already; a group is open while members that have not led are of several components.
    Round ONE_LEADER verifies the pairs of texts of open groups that share a rare shingle instead. From then on only their other
    shingles (common) count for the texts left, and one with so few of these that none can be similar has led.
    """
    of = lambda end, name: sets.select(F.col("rep").alias(end), F.col("shingles").alias(name))
    state = written(sets.select("rep", F.col("rep").alias("component"), (F.length("shingles") / 8).alias("size"), (F.length("shingles") / 8).alias("common")))
    led = None
    for k in itertools.count():
        waiting = members.join(state, "rep")
        if led is not None:
            waiting = waiting.join(led, "rep", "left_anti")
        waiting = written(waiting)
        foremost = F.min(F.struct((-F.col("weight")).alias("by"), F.xxhash64(F.lit(k), "rep").alias("drawn"), F.col("rep").alias("leader")))
        groups = waiting.groupBy("key").agg(foremost.alias("foremost"), F.count("*").alias("left"), F.min("component").alias("low"), F.max("component").alias("high"))
        live = written(waiting.join(groups.where("low <> high").select("key", "foremost", "left"), "key"))
        if live.isEmpty():
            dropped(waiting, live)
            return state.select("rep", "component")
        if k == ONE_LEADER:
            numbers, pairs = _rare(sets.join(live.select("rep").distinct(), "rep", "left_semi"))
            state, old = written(state.join(numbers, "rep", "left").select("rep", "component", "size", (F.col("size") - F.coalesce("n", F.lit(0))).alias("common"))), state
            pairs, leaders = written(pairs), written(state.where(F.col("common") < SIMILAR * F.col("size")).select("rep"))
            dropped(old)
        else:
            leaders, pairs = _led(live, sets, k)
        verified = pairs.join(of("v", "b"), "v").join(of("u", "a"), "u").select("u", "v", "a", "b").mapInArrow(_similar, "u long, v long")
        to = lambda end: state.select(F.col("rep").alias(end), F.col("component").alias(f"to_{end}"))
        merged = components(verified.join(to("u"), "u").join(to("v"), "v").select(F.col("to_u").alias("u"), F.col("to_v").alias("v")))
        old, state = state, written(state.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("rep", F.coalesce("to", "component").alias("component"), "size", "common"))
        was, led = led, leaders if led is None else written(led.union(leaders))
        dropped(waiting, live, pairs, merged, old, *([was, leaders] if was is not None else []))


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those that are copies of a document with a lesser doc_id."""
    slim = docs.where("doc_id is not null").select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    marks = written(slim.mapInArrow(per_slice(_mark), MARKS))
    texts = written(marks.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    members = _grouped(texts)
    # Ids are written, so that Spark knows how few they are before it decides whether to move the texts to them.
    wanted = written(members.select(F.col("rep").alias("doc_id")).distinct())
    whole = F.max(F.struct("shingles", *SKETCH)).alias("x")
    sets = written(slim.join(wanted, "doc_id", "left_semi").mapInArrow(per_slice(_sets), SETS).groupBy("doc_id").agg(whole).select(F.col("doc_id").alias("rep"), "x.*"))
    groups = _joined(members, sets).withColumnRenamed("rep", "node")
    first = groups.groupBy("component").agg(F.min("node").alias("first"))
    gone = groups.join(first, "component").where("node <> first").select(F.col("node").alias("rep"))
    stay = texts.select("rep").join(gone, "rep", "left_anti").select(F.col("rep").alias("doc_id"))
    lost = written(marks.select("doc_id").distinct().join(stay, "doc_id", "left_anti"))
    repeated = not marks.groupBy("doc_id").count().where("count > 1").isEmpty()
    dropped(marks, texts, members, sets, wanted)
    kept = docs.join(lost, "doc_id", "left_anti")  # and all without a doc_id
    if not repeated:
        return kept
    row = F.struct(F.coalesce(text, F.lit("")), F.struct(*docs.columns).alias("row"))
    return kept.where("doc_id is not null").groupBy("doc_id").agg(F.min(row).alias("least")).select("least.row.*").unionByName(docs.where("doc_id is null"))
