"""URL filters by a cascade of Bloom filters.

Every URL names a few keys: suffixes of its host with starts of its path, in the shapes that the
rules have, and the words of its host and path. The distinct keys of the whole corpus are the universe. Level
0 of the cascade encodes the listed keys; level 1 encodes the unlisted keys of the universe that
pass level 0; level 2 the listed ones that pass level 1; and so on until nothing passes wrongly. A
key of the universe is listed exactly if the first level that it fails is odd, so the URLs are judged
in one scan with no join. The filters' size follows the list (level 0 lets about as many wrong keys pass as
there are listed ones), not the corpus. Lists of any length are dealt by hash to cascades of about MAX_LISTED
keys, each built apart and each asked only for its own keys. What is left after MAX_LEVELS levels is kept as it is.

Where no rule fits, words decide: one of STRICT_WORDS blocks, and so do SOFT_LEAST different ones of SOFT_WORDS.

A null URL, or one without ://, has an empty host and path and no keys: no rule fits and it is allowed. URLs are
read whole, however long; repeated rows are judged alike; an empty table gives an empty one; columns of the input
that bear the names of those added are replaced, and any other name may occur.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.llm.common import dropped, mix, written

MAX_LISTED = 1_000_000
MAX_LEVELS = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"), ("allow", "net", "/de/"), ("block", "org", "/es/")]
#: Words of hosts and paths. One of the first kind says what the page is; those of the second kind also occur elsewhere.
STRICT_WORDS = "porn porno xxx xvideos hentai milf escorts camgirls bdsm viagra cialis levitra casino casinos sportsbook warez keygen crackz torrentz payday backlinks blackhat".split()
SOFT_WORDS = "adult affiliate bet bets betting bingo bonus buy cheap clickbait coupon coupons crack crypto cam cams dating deals diet discount download escort farm forex free gambling girls hot jackpot loan loans lottery naked nude nulled online pharmacy pills poker promo replica roulette serial seo sex sexy slots spam torrent watches win".split()
SOFT_LEAST = 2


class Bloom:
    """A Bloom filter over 128-bit keys, as a bit array."""

    def __init__(self, n: int, rate: float, level: int):
        self.level, self.k = level, max(1, round(-math.log2(rate)))
        self.bits = np.zeros(max(64, int(n * -math.log(rate) / math.log(2) ** 2)) // 8 + 8, np.uint8)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = mix(a ^ np.uint64(self.level * 0x9E3779B97F4A7C15 % 2**64)), mix(b + np.uint64(self.level)) | np.uint64(1)
        return (x[:, None] + np.arange(self.k, dtype=np.uint64) * y[:, None]) % np.uint64(8 * len(self.bits))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        at = self.places(a, b).ravel()
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.places(a, b)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


class Rest:
    """A level that holds its keys as they are."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.keys = set(zip(a.tolist(), b.tolist()))

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.fromiter((k in self.keys for k in zip(a.tolist(), b.tolist())), bool, len(a))


def listed(levels: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which keys of the universe are listed: those whose first failed level is odd."""
    failed = np.full(len(a), len(levels))
    live = np.arange(len(a))
    for k, level in enumerate(levels):
        ok = level.has(a[live], b[live]) if len(live) else np.zeros(0, bool)
        failed[live[~ok]] = k
        live = live[ok]
    return failed % 2 == 1


def listed_among(cascades: list[list], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which keys are listed, each asked of the cascade that it is dealt to."""
    to, out = (a % np.uint64(len(cascades))).astype(np.int64), np.zeros(len(a), bool)
    for k, levels in enumerate(cascades):
        mine = np.flatnonzero(to == k)
        out[mine] = listed(levels, a[mine], b[mine])
    return out


def _hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("a", "b"))


def _collected(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = np.array([(r.a, r.b) for r in keys.collect()], np.int64).reshape(-1, 2).view(np.uint64)
    return found[:, 0].copy(), found[:, 1].copy()


def cascade(universe: DataFrame, keys: DataFrame) -> list:
    """The levels. universe, keys: distinct a, b long, all keys of the corpus and the listed ones (about MAX_LISTED at most)."""
    spark = universe.sparkSession
    a, b = _collected(keys)
    others = universe.join(F.broadcast(keys), ["a", "b"], "left_anti")
    n_others = others.count()
    levels: list = []

    def passing(df: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(levels[-1])

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(shared.value.has(*_hashes(batch))))

        return written(df.mapInArrow(run, "a long, b long"))

    rate = min(0.5, max(len(a), 1) / max(n_others, 1))
    while len(a):
        if len(levels) >= MAX_LEVELS:
            return [*levels, Rest(a, b)]
        levels.append(Bloom(len(a), rate if not levels else 0.5, len(levels)))
        levels[-1].add(a, b)
        # About as many wrong keys pass level 0 as there are listed ones; each later level halves what is left.
        before, others = others, passing(others)
        dropped(before)
        wrong = _collected(others)
        if not len(wrong[0]):
            break
        levels.append(Bloom(len(wrong[0]), 0.5, len(levels)))
        levels[-1].add(*wrong)
        ok = levels[-1].has(a, b)
        a, b = a[ok], b[ok]
    dropped(others)
    return levels or [Rest(a, b)]


def cascades(universe: DataFrame, keys: DataFrame, most: int = MAX_LISTED) -> list[list]:
    """Cascades that the keys are dealt to by hash, about so many at most to one."""
    n = max(1, -(-keys.count() // most))
    mine = lambda df, k: df.where(F.expr(f"pmod(pmod(a, {n}) + if(a < 0, {2**64 % n}, 0), {n}) = {k}")) if n > 1 else df  # noqa: E731  a as unsigned
    return [cascade(mine(universe, k), mine(keys, k)) for k in range(n)]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _keyed(text: Column) -> Column:
    return F.struct(text.alias("key"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, strict: list[str] = STRICT_WORDS, soft: list[str] = SOFT_WORDS, url: str = "url") -> DataFrame:
    """All rows and columns, with host, path, rule (host and path of the longest rule that fits; null: none),
    spam_words (listed words of host and path) and verdict (block or allow: the rule's; without one, the words')."""
    added = ["host", "path", "rule", "spam_words", "verdict"]
    pages = pages.drop(*added)
    spark = pages.sparkSession
    named = pages.select(F.struct(*pages.columns).alias("row"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    labels = F.split("host", r"\.")
    keys = [F.when((F.size(labels) >= n) & (F.length("path") >= m), F.concat(F.lit("r:"), F.array_join(F.slice(labels, -n, n), "."), F.substring("path", 1, m))) for n, m in shapes]
    parts = F.array_distinct(F.filter(F.split(F.concat("host", F.lit(" "), _lowered(F.col("path"))), r"[^a-z0-9]+"), lambda x: x != ""))
    every = F.concat(F.filter(F.array(*keys), lambda x: x.isNotNull()), F.transform(parts, lambda x: F.concat(F.lit("w:"), x)))
    named = named.withColumn("keys", F.transform(every, _keyed))
    mine = [f"r:{h}{p}" for _, h, p in rules] + [f"w:{w}" for w in (*strict, *soft)]
    want = spark.createDataFrame([(k,) for k in dict.fromkeys(mine)], "key string").select(_keyed(F.col("key")).alias("k")).select("k.a", "k.b")
    universe = written(named.select(F.explode("keys").alias("k")).select("k.a", "k.b").distinct())
    shared = spark.sparkContext.broadcast(cascades(universe, want))
    dropped(universe)

    def run(batches):
        for batch in batches:
            lists = batch.column("keys")
            flat = lists.flatten()
            hit = listed_among(shared.value, *(np.asarray(flat.field(c)).astype(np.int64).view(np.uint64) for c in ("a", "b"))) if len(flat) else np.zeros(0, bool)
            ends = np.concatenate([[0], np.cumsum(hit)])[np.asarray(lists.offsets) - lists.offsets[0].as_py()].astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), flat.field("key").filter(pa.array(hit)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "host", "path")), found], names=["row", "host", "path", "found"])

    judged = named.mapInArrow(run, T.StructType([named.schema["row"], named.schema["host"], named.schema["path"], T.StructField("found", T.ArrayType(T.StringType()))]))
    kind = lambda c, which: F.transform(F.filter(c, lambda k: k.startswith(which)), lambda k: k.substr(F.lit(3), F.length(k)))
    verdicts = F.create_map(*(F.lit(x) for v, h, p in rules for x in (h + p, v))) if rules else F.create_map().cast("map<string,string>")
    rule = F.array_max(F.transform(kind("found", "r:"), lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"))))["rule"]
    words = F.col("spam_words")
    bad = F.exists(words, lambda x: x.isin(*strict)) | (F.size(F.filter(words, lambda x: x.isin(*soft))) >= SOFT_LEAST)
    out = judged.withColumns({"rule": rule, "spam_words": F.array_sort(kind("found", "w:"))})
    return out.withColumn("verdict", F.coalesce(F.element_at(verdicts, F.col("rule")), F.when(bad, "block").otherwise("allow"))).select("row.*", *added)


def digest(pages: DataFrame) -> DataFrame:
    return url_filter(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def digest_sql() -> str:
    """The same rows by brute force, for DuckDB."""
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in cases) + " end"
    known = "case " + " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in cases)
    of = lambda words: "len(list_filter(words, lambda x: x in (" + ", ".join(f"'{w}'" for w in words) + ")))"
    return f"""with u as (
      select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') as host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
    v as (select *, list_distinct(regexp_split_to_array(host || ' ' || translate(path, '{UPPER}', '{UPPER.lower()}'), '[^a-z0-9]+')) as words from u)
    select page_id, host, path, {rule} as rule, {known} when {of(STRICT_WORDS)} > 0 or {of(SOFT_WORDS)} >= {SOFT_LEAST} then 'block' else 'allow' end as verdict from v"""
