"""Token counts from a deterministic transducer compiled, as needed, from a byte-level BPE tokenizer.

A state holds what the token count can still depend on within a pre-token: the longest suffix read that begins some
token (a node of an Aho-Corasick automaton), the last token of the encoding of each prefix ending there, and the counts
of those prefixes relative to now. Reading a byte picks the one token that ends here and fits what stands before it (two
tokens fit if the merge rules leave them apart side by side), and the transition is annotated with the change of the
count. States and transitions are made when first met and kept by the process, up to a bound between blocks of text.

Pre-token borders are a function of the classes of a few neighbouring characters; reading a border returns to the start.
So the state map of a chunk of bytes with a border is constant: chunks are run at once from their first borders, a
prefix scan over the maps gives each chunk's state on entry, and what stands before its first border is run from there.

Cases: a null text is empty, with no bytes and no tokens. Equal rows get equal counts. Special strings count as one
token, as the library has them by default. An empty table gives an empty result. Clashing columns are dropped.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.words import blocks, cache
from quarry.session import ship

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
CHUNK, BLOCK, MOST_STATES = 512, 1 << 22, 250_000
START = -1
OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
#: White space of the pre-tokenizer's pattern (Unicode White_Space).
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def char_classes() -> np.ndarray:
    of = {"L": LETTER, "N": NUMBER}
    c = np.frombuffer(bytes(of.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8).copy()
    c[WHITE] = SPACE
    return c


def borders(chars: np.ndarray, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which characters begin a pre-token; first: which begin a text."""
    c = cls[chars]
    last = np.append(first[1:], True)
    before = np.where(first, EDGE, np.append(EDGE, c[:-1]))
    after = np.where(last, EDGE, np.append(c[1:], EDGE))
    blank_before = np.append(False, chars[:-1] == 32) & ~first
    space = c == SPACE
    out = np.where(space, (before != SPACE) | ((after != SPACE) & (after != EDGE)), np.where(before == SPACE, ~blank_before, before != c))
    # 's 't 'm 'd 're 've 'll where the quote begins a pre-token by itself
    q = np.flatnonzero((chars == 39) & out & ~blank_before & ~last)
    if len(q):
        at = lambda k: np.where(q + k < len(chars), chars[np.minimum(q + k, len(chars) - 1)], 0)
        one = np.isin(at(1), [ord(x) for x in "stmd"])
        two = np.zeros(len(q), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (at(1) == ord(x)) & (at(2) == ord(y))
        two &= ~one & ~first[np.minimum(q + 2, len(chars) - 1)]
        for ok, n in ((one, 1), (two, 2)):
            out[q[ok] + 1] = False
            e = q[ok] + n + 1
            out[e[e < len(chars)]] = True
    return out


class Transducer:
    def __init__(self, spec: dict):
        alphabet = byte_alphabet()
        model = spec["model"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        ids = model["vocab"]
        raw = {i: bytes(alphabet[c] for c in t) for t, i in ids.items() if t not in self.specials}
        self.length = {i: len(b) for i, b in raw.items()}
        self.rank = dict.fromkeys(raw, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            t = ids[a + b]
            self.merged[ids[a], ids[b]] = r
            self.rank[t], self.parts[t] = r, (ids[a], ids[b])
        self._fits: dict[tuple[int, int], bool] = {}
        self._depths: dict[int, tuple[int, ...]] = {}
        self._automaton(raw)
        self.reset()

    def _automaton(self, raw: dict[int, bytes]) -> None:
        """goto, failure and next-shorter-token links over all tokens."""
        self.goto: list[dict[int, int]] = [{}]
        self.depth, self.token = [0], [START]
        for i, b in raw.items():
            at = 0
            for x in b:
                nxt = self.goto[at].get(x)
                if nxt is None:
                    nxt = self.goto[at][x] = len(self.goto)
                    self.goto.append({})
                    self.depth.append(self.depth[at] + 1)
                    self.token.append(START)
                at = nxt
            self.token[at] = i
        self.fail, self.shorter = [0] * len(self.goto), [0] * len(self.goto)
        queue = list(self.goto[0].values())
        for at in queue:
            f = self.fail[at]
            self.shorter[at] = f if self.token[f] != START else self.shorter[f]
            for x, nxt in self.goto[at].items():
                queue.append(nxt)
                g = f
                while g and x not in self.goto[g]:
                    g = self.fail[g]
                self.fail[nxt] = self.goto[g].get(x, 0)

    def depths(self, node: int) -> tuple[int, ...]:
        """How far back a token of the future can begin: the lengths of the suffixes that begin some token."""
        found = self._depths.get(node)
        if found is None:
            found = self._depths[node] = (self.depth[node], *self.depths(self.fail[node])) if node else (0,)
        return found

    def reset(self) -> None:
        self.states: list[tuple] = [(0, ((START, 0),))]
        self.index = {self.states[0]: 0}
        self.column = np.full(256, -1, np.int64)
        self.width = 128
        self.next = np.full((4096, self.width), -1, np.int32)
        self.delta = np.zeros((4096, self.width), np.int8)
        self.used = 0

    def fits(self, a: int, b: int) -> bool:
        """Whether the merge rules leave a and b as they are side by side: going back in time along a's right and b's left
        edge, no pair of pieces that stood side by side merges before either is merged away (leftmost first)."""
        known = self._fits.get((a, b))
        if known is None:
            x, y, till_x, till_y, known = a, b, sys.maxsize, sys.maxsize, True
            while True:
                m = self.merged.get((x, y))
                if m is not None and m < till_x and m <= till_y:
                    known = False
                    break
                rx, ry = self.rank[x], self.rank[y]
                if rx < 0 and ry < 0:
                    break
                if rx > ry:
                    till_x, x = rx, self.parts[x][1]
                else:
                    till_y, y = ry, self.parts[y][0]
            self._fits[a, b] = known
        return known

    def make(self, state: int, byte: int) -> None:
        """Add the transition of state by byte."""
        node, held = self.states[state]
        old = dict(zip(self.depths(node), held, strict=True))
        while node and byte not in self.goto[node]:
            node = self.fail[node]
        node = self.goto[node].get(byte, 0)
        at = node if self.token[node] != START else self.shorter[node]
        while True:
            t = self.token[at]
            before, count = old[self.length[t] - 1]
            if before == START or self.fits(before, t):
                break
            at = self.shorter[at]
        change = count + 1
        key = (node, tuple((old[n - 1][0], old[n - 1][1] - change) if n else (t, 0) for n in self.depths(node)))
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.next):
                self.next = np.concatenate((self.next, np.full_like(self.next, -1)))
                self.delta = np.concatenate((self.delta, np.zeros_like(self.delta)))
        self.next[state, self.column[byte]] = to
        self.delta[state, self.column[byte]] = change

    def columns(self, data: np.ndarray) -> np.ndarray:
        """data with each byte as its column of the tables."""
        new = np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0))
        self.column[new] = np.arange(self.used, self.used + len(new))
        self.used += len(new)
        if self.used > self.width:
            self.next = np.concatenate((self.next, np.full((len(self.next), 256 - self.width), -1, np.int32)), axis=1)
            self.delta = np.concatenate((self.delta, np.zeros((len(self.delta), 256 - self.width), np.int8)), axis=1)
            self.width = 256
        return self.column[data].astype(np.uint8)

    def run(self, data: np.ndarray, cols: np.ndarray, start: np.ndarray, at: np.ndarray, till: np.ndarray, state: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Run lanes at..till from their states at once; out gets each byte's change of the count. The states at the end."""
        order = np.argsort(at - till, kind="stable")  # longest first: those that end leave from the back
        at, n, state = at[order], (till - at)[order], state[order].astype(np.int64)
        live = len(at) - np.searchsorted(n[::-1], np.arange(int(n[0]) + 1 if len(n) else 1), side="right")
        for step in range(int(n[0]) if len(n) else 0):
            k = live[step]
            p = at[:k] + step
            s = np.where(start[p], 0, state[:k])
            c = cols[p]
            to = self.next[s, c]
            if (missing := np.flatnonzero(to < 0)).size:
                for key in np.unique(s[missing] * 256 + data[p[missing]]).tolist():
                    self.make(key >> 8, key & 255)
                to = self.next[s, c]
            out[p] = self.delta[s, c]
            state[:k] = to
        end = np.empty_like(state)
        end[order] = state
        return end

    def changes(self, data: np.ndarray, start: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """The change of the count at each byte; start: where pre-tokens begin, the first byte among them."""
        if len(self.states) > MOST_STATES:
            self.reset()
        cols, out, n = self.columns(data), np.zeros(len(data), np.int8), len(data)
        low = np.arange(0, n, chunk)
        high = np.minimum(low + chunk, n)
        marks = np.append(np.flatnonzero(start), n)
        border = marks[np.searchsorted(marks, low)]  # first border from the chunk's begin on
        constant = border < high
        at = np.flatnonzero(constant)
        exits = np.zeros(len(low), np.int64)
        exits[at] = self.run(data, cols, start, border[at], high[at], np.zeros(len(at), np.int64), out)
        # scan: composed with what precedes, a chunk's map is that of the last chunk with a border
        source = np.maximum.accumulate(np.where(constant, np.arange(len(low)), -1))
        heads = np.flatnonzero(np.append(False, constant[:-1]) & (border > low))  # with their chunks that have no border
        self.run(data, cols, start, low[heads], border[heads], exits[source[heads - 1]], out)
        return out


_kept: dict = cache()


def transducer(path: str) -> tuple[Transducer, np.ndarray]:
    if path not in _kept:
        _kept.clear()
        with open(path, encoding="utf-8") as f:
            _kept[path] = Transducer(json.load(f)), char_classes()
    return _kept[path]


#: Characters above which a text is cut, and where.
LONG = 1 << 20
BORDER = re.compile(r" (?=[A-Za-z0-9])|(?<=\S\n)(?=[A-Za-z])")


def pieces(text: str, size: int = LONG) -> Iterator[str]:
    """A long text in pieces of about size characters, cut where a pre-token begins whatever is around it.

    That is before a space and an ASCII letter or digit, or between a line's single end and a letter. Where there is no
    such place the piece goes on.
    """
    a = 0
    while len(text) - a > size and (m := BORDER.search(text, a + size)):
        yield text[a : m.start()]
        a = m.start()
    yield text[a:]


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Number of tokens of each text, special strings as one each. Long texts are worked on piece by piece."""
    fst, cls = transducer(path)
    if any(len(t) > LONG for t in texts):
        return [sum(count_tokens([x], path)[0] for x in pieces(t)) if len(t) > LONG and BORDER.search(t, LONG) else counted([t], fst, cls)[0] for t in texts]
    return counted(texts, fst, cls)


def counted(texts: list[str], fst: Transducer, cls: np.ndarray) -> list[int]:
    parts: list[str] = []
    owner: list[int] = []
    counts = [0] * len(texts)
    for i, t in enumerate(texts):
        pieces = [t]
        for s in fst.specials:
            if s in t:
                pieces = [y for x in pieces for y in x.split(s)]
        counts[i] = len(pieces) - 1
        for x in pieces:
            if x:
                parts.append(x)
                owner.append(i)
    if parts:
        whole = "".join(parts)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        n = np.array([len(x) for x in parts])
        begin = np.concatenate(([0], np.cumsum(n)[:-1]))
        first = np.zeros(len(chars), bool)
        first[begin] = True
        width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        place = np.concatenate(([0], np.cumsum(width)))
        data = np.frombuffer(whole.encode(), np.uint8)
        start = np.zeros(len(data), bool)
        start[place[:-1][borders(chars, cls, first)]] = True
        sums = np.add.reduceat(fst.changes(data, start).astype(np.int64), place[begin])
        for i, k in zip(owner, sums.tolist(), strict=True):
            counts[i] += k
    return counts


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        raw = [t.encode() for t in texts]
        for a, b in blocks(raw, BLOCK):
            n = count_tokens(texts[a:b], path)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in raw[a:b]], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], schema=SCHEMA)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs (doc_id, text); path: the tokenizer's file on each node."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(partial(count, path=path, limit=limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
