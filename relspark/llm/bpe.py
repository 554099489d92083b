"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Encoding. The merges are compiled into a nondeterministic transducer whose paths are token
sequences in which every two neighbours stay apart when merged alone; exactly one such path spells
a byte string, and it is the one that the merges give. A configuration is the last token of a path
and the place in the trie of tokens that its unfinished token has reached; sets of configurations
become states of a deterministic transducer the first time they are reached. A step says which
token, if any, ends at this byte on the one path to it. Tokens are written as far as all live
configurations agree, so output lags by no more than the tokens that are still open, at most
BLOCK bytes and the longest token. Time is linear in the text, whatever its runs look like.

Decoding. Tokens are fed one by one through an incremental UTF-8 machine: its state is the
unfinished byte sequence, and (state, token) transitions are kept once computed. Malformed bytes
become U+FFFD, as in Python's "replace" handler.

A worker keeps its codec from task to task: transitions and pieces of text met before, up to the
bounds below. What is kept never changes a result.

Nulls count as empty texts; an empty text has no tokens and decodes to the empty string. Very long
texts are encoded whole, one piece at a time; repeated rows are encoded as often as they stand
there; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.llm.common import release

MAX_STEPS, MAX_PIECES = 800_000, 200_000
"""Transitions (and pairs of tokens) kept before they are built anew; pieces of each of two generations, of which the older goes when the younger is full."""
BLOCK = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


NEVER = 1 << 60
START = (1 << 24) - 1
"""What stands for the last token before the first one; ranks are below it."""


class Transducer:
    """Encodes byte strings by merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        self.child: dict[int, int] = {}
        self.rank_at, self.inner = [NEVER], [True]
        for data, rank in ranks.items():
            node = 0
            for byte in data:
                self.inner[node] = True
                to = self.child.setdefault(node << 8 | byte, len(self.rank_at))
                if to == len(self.rank_at):
                    self.rank_at.append(NEVER)
                    self.inner.append(False)
                node = to
            self.rank_at[node] = rank
        self.depth = [0] * len(self.rank_at)
        for key, to in self.child.items():  # parents come before their children
            self.depth[to] = self.depth[key >> 8] + 1
        self.apart: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.reset()

    def reset(self) -> None:
        start = (START << 32,)
        self.number = {start: 0}
        self.states = [start]
        self.steps: dict[int, int] = {}

    def edge(self, rank: int, side: int) -> tuple[int, ...]:
        """The tokens that stand at the right (1) or left (0) edge of a token while its merges run, in order."""
        known = self.edges[side].get(rank)
        if known is None:
            parts = [self.ranks[self.token[rank][i : i + 1]] for i in range(len(self.token[rank]))]
            known = (parts[-side],)
            while len(parts) > 1:
                best, at = min((self.joined(a, b), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                parts[at : at + 2] = [best]
                if parts[-side] != known[-1]:
                    known += (parts[-side],)
            self.edges[side][rank] = known
        return known

    def joined(self, left: int, right: int) -> int:
        return self.ranks.get(self.token[left] + self.token[right], NEVER)

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border when the two tokens' bytes are merged together.

        Merges run by rank, so both edges grow in known steps; a crossing happens where the edges
        of some moment join before either of them grows (equal ranks: the leftmost first).
        """
        key = left << 20 | right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= MAX_STEPS:
                self.apart.clear()
            a, b, i, j, known = self.edge(left, 1), self.edge(right, 0), 0, 0, True
            while known:
                grow_a = a[i + 1] if i + 1 < len(a) else NEVER
                grow_b = b[j + 1] if j + 1 < len(b) else NEVER
                cross = self.joined(a[i], b[j])
                if cross < grow_a and cross <= grow_b and cross != NEVER:
                    known = False
                elif grow_a == grow_b == NEVER:
                    break
                elif grow_a <= grow_b:
                    i += 1
                else:
                    j += 1
            self.apart[key] = known
        return known

    def step(self, state: int, byte: int) -> int:
        """The next state, and (in the low 24 bits) the token that ends here, or START."""
        live, end, child, inner, rank_at = [], START, self.child, self.inner, self.rank_at
        for pair in self.states[state]:
            to = child.get((pair & 0xFFFFFFFF) << 8 | byte)
            if to is None:
                continue
            last = pair >> 32
            if inner[to]:
                live.append(last << 32 | to)
            if end == START and (rank := rank_at[to]) != NEVER and (last == START or self.fits(last, rank)):
                end = rank  # one configuration at most ends a token here
        if end != START:
            live.append(end << 32)
        key = tuple(live)
        to = self.number.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
        out = self.steps[state << 8 | byte] = to << 24 | end
        return out

    def encode(self, data: bytes) -> list[int]:
        if data in self.ranks:
            return [self.ranks[data]]
        if len(self.steps) > MAX_STEPS:
            self.reset()
        if len(data) > BLOCK:
            return self.encode_long(data)
        ends, steps, at = [], self.steps, 0
        for byte in data:
            key = at | byte
            at = steps.get(key)
            if at is None:
                at = self.step(key >> 8, byte)
            ends.append(at & 0xFFFFFF)
            at = at >> 24 << 8
        return self.path(ends, len(ends))

    def path(self, ends: list[int], to: int) -> list[int]:
        """The tokens of the one path to a place, from the tokens that end at each place."""
        out, token = [], self.token
        while to > 0:
            out.append(ends[to - 1])
            to -= len(token[out[-1]])
        out.reverse()
        return out

    def encode_long(self, data: bytes) -> list[int]:
        """As encode(), with what is certain written after each block."""
        out, ends, state = [], [], 0
        for at in range(0, len(data), BLOCK):
            for byte in data[at : at + BLOCK]:
                step = self.steps.get(state << 8 | byte) or self.step(state, byte)
                ends.append(step & 0xFFFFFF)
                state = step >> 24
            starts = {len(ends) - self.depth[pair & 0xFFFFFFFF] for pair in self.states[state]}
            while len(starts) > 1:  # back to where all live configurations have come from
                last = max(starts)
                starts.remove(last)
                starts.add(last - len(self.token[ends[last - 1]]))
            sure = starts.pop()
            out += self.path(ends, sure)
            del ends[:sure]
            if len(self.steps) > MAX_STEPS:
                live = self.states[state]
                self.reset()
                state = self.number.setdefault(live, len(self.states))
                if state == len(self.states):
                    self.states.append(live)
        return out + self.path(ends, len(ends))


class Pieces(dict):
    """Pieces of text to their ids as little-endian 32-bit integers, filled as they are asked for."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.transducer.encode(piece.encode("utf-8", "replace"))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Decoder:
    """Turns token ids into text, in any number of calls to feed()."""

    def __init__(self, token: dict[int, bytes]):
        self.token, self.known, self.state = token, {}, b""
        self.whole: list[str | None] = [None] * (max(token, default=-1) + 1)
        for i, data in token.items():
            at, text = b"", ""
            for byte in data:
                at, more = self.advance(at, byte)
                text += more
            self.whole[i] = None if at or "\ufffd" in text else text

    @staticmethod
    def advance(state: bytes, byte: int) -> tuple[bytes, str]:
        """One byte: the unfinished sequence and the text that became certain."""
        if state:
            lead, low, high = state[0], 0x80, 0xBF
            if len(state) == 1:
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (low, high))
            if low <= byte <= high:
                grown = state + bytes((byte,))
                full = len(grown) == (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
                return (b"", grown.decode()) if full else (grown, "")
            rest, text = Decoder.advance(b"", byte)
            return rest, "�" + text
        if byte < 0x80:
            return b"", chr(byte)
        if 0xC2 <= byte <= 0xF4:
            return bytes((byte,)), ""
        return b"", "�"

    def feed(self, ids: list[int]) -> str:
        """The text that is certain after these ids. Runs of tokens that are whole texts need no machine."""
        out = [self.whole[i] for i in ids]
        at = 0 if self.state else out.index(None) if None in out else len(out)
        while at < len(out):
            out[at] = self.move(ids[at])
            if self.state:
                at += 1
            else:
                try:
                    at = out.index(None, at + 1)
                except ValueError:
                    break
        return "".join(out)

    def move(self, token: int) -> str:
        key = (self.state, token)
        found = self.known.get(key)
        if found is None:
            at, text = self.state, ""
            for byte in self.token[token]:
                at, more = self.advance(at, byte)
                text += more
            if len(self.known) >= MAX_STEPS:
                self.known.clear()
            found = self.known[key] = (at, text)
        self.state = found[0]
        return found[1]

    def close(self) -> str:
        state, self.state = self.state, b""
        return "�" if state else ""


def splitters(pattern: str) -> tuple[Callable, Callable]:
    """Functions that give the matches of the pattern (without groups): for any text, and a faster one for
    Latin-1 texts, in which the classes of letters, numbers and white space are spelt out. White space is
    Unicode's property, as in the public tokenizers' own libraries, not Python's wider class."""
    here = [chr(c) for c in range(256)]
    spelt = {name: "".join(re.escape(c) for c in here if regex.fullmatch(rf"\p{{{name}}}", c)) for name in ("L", "N", "White_Space")}
    spaced = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    latin, inside = "", False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", spaced, re.S):
        if m := re.fullmatch(r"\\([pP])\{(\w+)\}", part):
            part = spelt[m[2]] if inside else f"[{'^' * (m[1] == 'P')}{spelt[m[2]]}]"
        inside = part == "[" or inside and part != "]"
        latin += part
    return regex.compile(spaced).findall, re.compile(latin).findall


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pieces = Pieces(self.transducer)
        self.any, self.latin = splitters(pattern)
        self.decoder = Decoder(self.transducer.token)

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any(text)
        return self.latin(text)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text or "")))

    def decode(self, ids: bytes) -> str:
        return self.decoder.feed(np.frombuffer(ids, "<u4").tolist()) + self.decoder.close()


_codecs: dict = {}
"""The codec of this worker process, kept from task to task."""


def _codec(shared, pattern: str) -> Codec:
    """The codec of this worker process for a vocabulary."""
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value, pattern)
    return _codecs[key]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", digests: bool = False) -> DataFrame:
    """All rows and columns, with n_tokens long and, of every whole text, ids array<int>.

    digests: instead of text and ids, ids_sha256 and decoded_sha256, of the ids as little-endian
    unsigned 32-bit integers and of the bytes that decoding them gives. Columns of the input that
    bear the names of those added are replaced.
    """
    added = ["n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids",))]
    docs = docs.drop(*added)
    others = [c for c in docs.columns if not (digests and c == text)]
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    kinds = [T.StructField("n_tokens", T.LongType())]
    kinds += [T.StructField(c, T.StringType()) for c in added[1:]] if digests else [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*(docs.schema[c] for c in others), *kinds])

    def run(batches):
        codec = _codec(shared, pattern)
        gc.disable()  # the codec's many small objects hold no cycles
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(text).to_pylist()
                ids = [codec.encode(t) for t in texts]
                cols = [batch.column(c) for c in others] + [pa.array([len(x) // 4 for x in ids], pa.int64())]
                if digests:
                    cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids]))
                    cols.append(pa.array([hashlib.sha256(codec.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]))
                else:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                yield pa.RecordBatch.from_arrays(cols, names=[*others, *added])
        gc.enable()
        release()

    return docs.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """All rows and columns with the text that the ids stand for (null for null)."""
    encoded = encoded.drop(to)
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    schema = T.StructType([*encoded.schema, T.StructField(to, T.StringType())])

    def run(batches):
        decoder = Decoder({r: b for b, r in shared.value.items()})
        for batch in batches:
            texts = [None if x is None else decoder.feed(x) + decoder.close() for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    return bpe_encode(docs.select("doc_id", F.col("text")), ranks_path, pattern, digests=True)
