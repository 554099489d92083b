"""License scan: ordered signature rules behind a keyword prefilter.

The rules (signatures.py) are hand-written signatures of licenses' own sentences, grants, names and
mentions, and tags with SPDX identifiers. Each names, by itself, the words that every match of it must
hold (keywords()). One Aho-Corasick pass over the lower-cased text finds which of those words occur; only
rules with all of theirs run, and no other could match. Detections are then taken in the order of
priority, length, place and rule, and one that lies within a detection already taken is dropped, so a
bare name inside a statement of that license is not counted again; a sweep with a prefix maximum finds
that in n log n. Phrases of a given list are looked for as consecutive words, whatever stands between
the words.

Nulls count as empty texts, which have no words and no detections. A text is scanned whole, however
long. Repeated rows are scanned as often as they stand there; an empty table gives an empty one; columns
of the input that bear the names of those added are replaced.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.llm.common import Words, per_slice
from relspark.llm.signatures import GRANT, IDENTIFIERS, SIGNATURES, TAGS

BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Bytes that separate words here: ASCII other than digits and letters, after lower-casing.
NOT_WORD = np.array([b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])

#: Texts are matched as UTF-8 bytes, each shown as one character.
RUN, WORD = r"[^0-9a-z\x80-\xff]+", r"[0-9a-z\x80-\xff]"
#: Words too common to tell rules apart; a rule is gated on others where it has any.
COMMON = frozenset("the and any for with this that under from are not you may its version software licen license public terms general copy use free".split())

DETECTION = "array<struct<label:string,start:int,end:int,score:double>>"


is_word = re.compile(WORD).match


def compiled(pattern: str) -> re.Pattern:
    """The pattern, with its spaces as runs of separators (an optional one as any number), between edges of words."""
    return re.compile(f"(?s)(?<!{WORD})(?:{pattern.replace(' ?', RUN[:-1] + '*').replace(' ', RUN)})(?!{WORD})")


def keywords(pattern: str) -> frozenset[str]:
    """Runs of letters and digits that every match of a pattern must hold: those outside of groups and classes, and not optional.

    With a = before it, a run that must be a whole word. Others have three letters or more.
    """
    runs, now, depth, at, start = [], "", 0, 0, 0
    while at <= len(pattern):
        c = pattern[at] if at < len(pattern) else " "
        if depth == 0 and c == "|":
            return frozenset()
        if c == "\\":
            at += 1  # an escape, of whatever kind, ends a run
        elif c in "[{":
            at = pattern.index("]" if c == "[" else "}", at + 2)
        depth += (c == "(") - (c == ")")
        if depth == 0 and c.isascii() and c.isalnum() and pattern[at + 1 : at + 2] not in ("?", "*", "{"):
            start = start if now else at
            now += c
        elif now:
            after, before = pattern[at:], pattern[:start]
            whole = (not before or before.endswith((" ", " )?"))) and (not after or after.startswith((" ", "(?: ")) and after[1:2] != "?" or after.startswith("(?: "))
            runs.append("=" * whole + now)
            now = ""
        at += 1
    found = frozenset(x for x in runs if len(x) >= 3)
    return frozenset(x for x in found if x.strip("=") not in COMMON) or found


def _identified() -> list[tuple[str, float, int, str]]:
    out: list[tuple[str, float, int, str]] = []
    for entry in IDENTIFIERS.replace("\n", "|").split("|"):
        label, _, names = entry.partition(":")
        for name in names.split():
            spelt = re.sub(r"[-.]", " ", name) + "(?: only| or later|\\+)?"
            out += [(label.strip(), score, priority, way.replace("{id}", spelt)) for score, priority, way in TAGS if way != "{id}" or re.search(r"-\d", name)]
    return out


class Rules:
    """The compiled rules, run behind the keyword prefilter."""

    def __init__(self):
        lines = [x.split(None, 3) for x in SIGNATURES.strip().split("\n")]
        spelt = [(label, float(score), int(priority), pattern.replace("{grant}", GRANT)) for label, score, priority, pattern in lines] + _identified()
        self.rules = [(keywords(pattern), label, compiled(pattern), score, priority) for label, score, priority, pattern in spelt]
        self.always = [k for k, (keys, *_) in enumerate(self.rules) if not keys]
        self.by_word: dict[str, list[int]] = {}
        for k, (keys, *_) in enumerate(self.rules):
            if keys:
                self.by_word.setdefault(max(keys, key=lambda x: (len(x), x)), []).append(k)
        self.words = ahocorasick.Automaton()
        self.whole = {w[1:] for keys, *_ in self.rules for w in keys if w[0] == "="}
        for word in {w.strip("=") for keys, *_ in self.rules for w in keys}:
            self.words.add_word(word, word)
        self.words.make_automaton()

    def find(self, text: str, prefilter: bool = True) -> list[tuple[str, int, int, float]]:
        """Detections (label, start, end, score) in a lower-cased text, by place; the same with and without the prefilter."""
        if prefilter:
            seen = set()
            for last, word in self.words.iter(text):
                if word not in seen:
                    seen.add(word)
                if word in self.whole and f"={word}" not in seen and not is_word(text[last + 1 : last + 2]) and not is_word(text[max(last - len(word), 0) : last - len(word) + 1]):
                    seen.add(f"={word}")
            which = sorted([*self.always, *(k for word in seen for k in self.by_word.get(word, ()) if self.rules[k][0] <= seen)])
        else:
            which = range(len(self.rules))
        found = []
        for k in which:
            _, label, pattern, score, priority = self.rules[k]
            found += [(-priority, m.start() - m.end(), m.start(), k, m.end(), label, score) for m in pattern.finditer(text)]
        return _outermost([(label, start, end, score) for _, _, start, _, end, label, score in sorted(found)])


def _outermost(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Of detections in their order, those that do not lie within an earlier taken one, by place."""
    starts = {x: k for k, x in enumerate(sorted({d[1] for d in found}), 1)}
    reach, taken = [0] * (len(starts) + 1), []  # reach: a Fenwick tree of the furthest end by start
    for d in found:
        k, furthest = starts[d[1]], -1
        while k:
            furthest = max(furthest, reach[k])
            k -= k & -k
        if furthest < d[2]:
            taken.append(d)
            k = starts[d[1]]
            while k < len(reach):
                reach[k] = max(reach[k], d[2])
                k += k & -k
    return sorted(taken, key=lambda x: x[1:3])


_rules: list[Rules] = []


def license_scan(docs: DataFrame, phrases: list[tuple[str, str]] = BASE, text: str = "text") -> DataFrame:
    """All columns but the text, with n_words long, detections (the rules', by place, as code points of
    the text) and places array<struct<label, word>> (where the words of phrases stand, by word)."""
    added = ["n_words", "detections", "places"]
    docs = docs.drop(*added)
    others = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField("n_words", T.LongType())])
    schema = schema.add("detections", T._parse_datatype_string(DETECTION)).add("places", T._parse_datatype_string("array<struct<label:string,word:long>>"))
    wanted = [(p.split(" "), label) for p, label in phrases]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not _rules:
            _rules.append(Rules())
        w = Words(batch.column(text), True, NOT_WORD)
        h = w.hashes()
        places: list[list] = [[] for _ in range(batch.num_rows)]
        for parts, label in wanted:
            n = len(parts)
            if len(h) < n:
                continue
            key = Words(pa.array([" ".join(parts)]), True, NOT_WORD).hashes()
            hit = w.row[: len(h) - n + 1] == w.row[n - 1 :]
            for k in range(n):
                hit &= h[k : len(h) - n + 1 + k] == key[k]
            for at in np.flatnonzero(hit).tolist():
                if all(w.text(at + k) == p.encode() for k, p in enumerate(parts)):
                    places[w.row[at]].append({"label": label, "word": at - int(w.first[w.row[at]])})
        found = []
        for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist()):
            hits = _rules[0].find(w.buf[a : b - 1].tobytes().decode("latin-1"))
            if hits:
                point = np.cumsum((w.buf[a:b] & 0xC0) != 0x80) - 1  # of each byte, the code point it belongs to
                hits = [(label, int(point[start]), int(point[end - 1]) + 1, score) for label, start, end, score in hits]
            found.append([dict(zip(("label", "start", "end", "score"), x)) for x in hits])
        kinds = [pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))]
        cols = [batch.column(c) for c in others] + [pa.array(w.count.astype(np.int64)), pa.array(found, kinds[0]), pa.array([sorted(p, key=lambda x: (x["word"], x["label"])) for p in places], kinds[1])]
        return pa.RecordBatch.from_arrays(cols, names=[*others, *added])

    return docs.mapInArrow(per_slice(make, text), schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id with counts, first and last place, labels and the best score of each document."""
    found = license_scan(docs.select("doc_id", "text"))
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*cols))), ",")
    word, base = F.col("places.word"), F.col("places.label")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
        labels(base).alias("base_labels"), labels(base, F.col("detections.label")).alias("labels"),
        F.greatest(F.coalesce(F.array_max("detections.score"), F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
