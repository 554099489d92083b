"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text's K-word runs are its k-mers; the least hash among the S-word runs inside one decides whether
it is chosen: it is if that least one stands at either edge. The choice depends on the run alone, so
an edit changes only the anchors that touch it, and anchors of unchanged parts agree between texts.
All anchors of the whole text are kept in order, with the word each starts at.

Texts are matched by position: an anchor matches where the anchor before it is the same and as many
words away (its link), and a link is located by the GRID-th of the text that it stands in. Likeness is
the mean of the shares of distinct links, and of distinct located links, that two texts have in common
(of all that either has). So moved passages lose the second share, and edits only what they touch.
The fingerprint is the KEPT least links as hexadecimal text (all of them where there are fewer), a dash,
and a hash of all anchors in order, which tells apart texts whose difference those links do not show.

A text of fewer than K words (some) is one anchor; without words, or null, the fingerprint is empty.
Two empty fingerprints have likeness 1, an empty one and another 0. The whole text is read, however long;
an empty table gives an empty one; columns of the input that bear the names of those added are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspark.llm.common import dropped, written

K, S, KEPT, GRID = 5, 2, 64, 8


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once."""
    return F.transform(F.array(x), f)[0]


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """at int and hash long of the chosen k-mers, by place. The words' hashes are computed once."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    run = lambda h, i, n: F.xxhash64(*(F.get(h, i + j) for j in range(n)))
    anchor = lambda i, x: F.struct(i.alias("at"), x.alias("hash"))

    def chosen(h: Column, inner: Column) -> Column:
        last = k - s

        def at_edge(i: Column) -> Column:
            edge = F.least(F.get(inner, i), F.get(inner, i + last))
            return edge <= F.least(*(F.get(inner, i + j) for j in range(1, last))) if last > 2 else edge <= F.get(inner, i + 1)

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(h) - k), at_edge), lambda i: anchor(i, run(h, i, k)))

    def of(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: run(h, i, s))
        whole = F.array(anchor(F.lit(0), F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))))
        return F.when(F.size(h) >= k, let(inner, lambda x: chosen(h, x))).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def placed(text: Column) -> Column:
    """whole long (a hash of all anchors in order), links and located array<long> (by place) of a text, as a struct."""

    def of(a: Column) -> Column:
        def links(last: Column) -> Column:
            def one(i: Column) -> Column:
                here, before = F.get(a, i), F.get(a, i - 1)
                return F.xxhash64(before["hash"], here["hash"], here["at"] - before["at"])

            return F.transform(F.sequence(F.lit(0), last), one)

        def struct(x: Column) -> Column:
            part = lambda i: F.floor(F.get(a, i)["at"] * GRID / (F.element_at(a, -1)["at"] + 1)).cast("int")
            return F.struct(F.xxhash64(a).alias("whole"), x.alias("links"), F.transform(x, lambda h, i: F.xxhash64(h, part(i))).alias("located"))

        none = F.array().cast("array<bigint>")
        return F.when(F.size(a) > 0, let(links(F.size(a) - 1), struct)).otherwise(F.struct(F.lit(None).cast("long").alias("whole"), none.alias("links"), none.alias("located")))

    return let(anchors(text), of)


def fingerprint(p: Column, kept: int = KEPT) -> Column:
    """The text form of what placed() gives."""
    word = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    least = F.slice(F.array_sort(F.array_distinct(p["links"])), 1, kept)
    return F.when(F.size(p["links"]) == 0, "").otherwise(F.concat(F.array_join(F.transform(least, word), ""), F.lit("-"), word(p["whole"])))


def likeness(p: Column, q: Column) -> Column:
    """Of what placed() gives for two texts, 0 to 1."""

    def shared(c: str) -> Column:
        return let(F.size(F.array_intersect(p[c], q[c])), lambda both: both / (F.size(F.array_distinct(p[c])) + F.size(F.array_distinct(q[c])) - both))

    return F.when((F.size(p["links"]) == 0) & (F.size(q["links"]) == 0), 1.0).otherwise((shared("links") + shared("located")) / 2)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns with fingerprint string and anchors array<struct<at, hash>>."""
    out = docs.drop("fingerprint", "anchors")
    return out.withColumns({"fingerprint": fingerprint(placed(F.col(text))), "anchors": anchors(F.col(text))})


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, rows, next_id, prev_id of the distinct doc_ids in ascending order (null first), as a ring."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("rows"))
    ranged = ids.repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"))
    at = written(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    end = F.struct("doc_id")
    parts = at.groupBy("part").agg(F.min_by(end, "at").alias("head"), F.max_by(end, "at").alias("tail"))  # a row for each task
    ring = Window.orderBy("part")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = parts.select("part", F.coalesce(F.lead("head").over(ring), F.first("head").over(whole)).alias("after"), F.coalesce(F.lag("tail").over(ring), F.last("tail").over(whole)).alias("before"))
    w = Window.partitionBy("part").orderBy("at")
    linked = at.join(around, "part").withColumns({"next": F.coalesce(F.lead(end).over(w), F.col("after")), "prev": F.coalesce(F.lag(end).over(w), F.col("before"))})
    out = written(linked.select("doc_id", "rows", F.col("next.doc_id").alias("next_id"), F.col("prev.doc_id").alias("prev_id")))
    dropped(at)
    return out


def digest(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text (its second half taken from the next document) and the next document.

    Rows of one doc_id share a next document; where that has several rows, its least text counts.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ring = neighbours(docs)
    lent = docs.join(ring.select(F.col("doc_id").alias("own_id"), "prev_id"), docs.doc_id.eqNullSafe(F.col("own_id")))
    if not ring.where("rows > 1").isEmpty():
        lent = lent.groupBy("own_id", "prev_id").agg(F.min("text").alias("text"))
    lent = lent.select("prev_id", F.col("text").alias("next_text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = docs.join(lent, docs.doc_id.eqNullSafe(lent.prev_id))
    made = pairs.select("doc_id", n.cast("long").alias("n_chars"), "text", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"), "next_text")
    both = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), placed(F.col("text")).alias("own"), placed(F.col("edited")).alias("other"), placed(F.col("next_text")).alias("next"))
    own, other, after = F.col("own"), F.col("other"), F.col("next")
    return both.select("doc_id", "n_chars", "edited_sha256", fingerprint(own).alias("fingerprint"), fingerprint(other).alias("edited_fingerprint"), likeness(own, other).alias("near_edited"), likeness(own, after).alias("near_next"))
