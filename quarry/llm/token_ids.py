"""Token ids of all documents in wavelet matrix files, a shard each, in ascending order of doc_id.

Documents are dealt by ranges of doc_id, so that the shards of one task follow those of the task before. The files are
cells of a table that Spark writes, so that failed and repeated tasks leave one copy, in any store.

Cases: a null text is empty: the end id alone. Documents without id come first. Equal ids stand side by side, ordered by
their text's hash. An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import accumulate, chain, compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.native import prefix_sums
from quarry.llm.wavelet import WaveletMatrix
from quarry.llm.words import blocks, cache
from quarry.session import ship, stored

TOKENIZER, END_ID, SHARD_TOKENS = "word_bpe_49k.json", 1, 1 << 20
#: Bytes of text encoded at once; words in each of two generations kept between blocks; the longest word kept.
BLOCK, MOST_WORDS, LONG_WORD = 1 << 22, 400_000, 48
NO_ID = -(1 << 63)
#: ASCII marks but the apostrophe: behind a letter or digit (of ASCII, or in two bytes) such tokenizers part them from it.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)
LETTERS = frozenset(c.encode() for c in map(chr, range(0x250)) if (c.isalpha() and c != "\u0130") or c in "0123456789")
#: Starts the names of special tokens; combining marks from U+0300 begin with one of these bytes.
SPECIAL, COMBINING = b"<|", (b"\xcc", b"\xcd")
#: Stands between words that are encoded together.
NUL = b"\0"


class Memory(dict):
    """Ids of strings in two generations of most entries each: what is met again moves on, the rest goes."""

    def __init__(self, most: int = MOST_WORDS) -> None:
        super().__init__()
        self.most = most
        self.older: dict[bytes, bytes] = {}

    def missing(self, wanted: set[bytes]) -> list[bytes]:
        """Those of wanted that neither generation has."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        new = wanted.difference(self)
        again = new.intersection(self.older)
        self.update((w, self.older[w]) for w in again)
        return list(new.difference(again))


class Encoder:
    """ids of texts by the tokenizers library, a word at a time where the tokenizer drops white space anyway.

    Normaliser, pre-tokeniser and merges of such a tokenizer never reach across white space: the ids of a text are
    those of its words, one after the other. Words are encoded when first met, many at once, and kept; marks behind a
    word's last letter or digit are words of their own. All that is tried on a probe; where it fails, texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.n_planes = max(1, (size - 1).bit_length())
        self.dtype = np.dtype("<u2" if self.n_planes <= 16 else "<u4")
        self.words, self.stems = Memory(), Memory()
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        nul = ids("\0")
        self.by_word = not ids(" \n\t\r") and ids("probe \n\t\rProbe") == ids("probe") * 2 and len(nul) == 1 and ids("a \0 b") == ids("a") + nul + ids("b")
        self.by_word = self.by_word and all(ids(f"{w}{m}") == ids(w) + ids(m) for w in ("probe", "9", "\xe9", "\xdf") for m in (",", ".%%", "$(", '"!?', "_", "-"))
        self.nul = np.array(nul[:1], self.dtype)

    def raw(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        if sys.byteorder == "big":
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, words: list[bytes]) -> list[bytes]:
        """Ids of words without NUL, a few hundred in one text."""
        out: list[bytes] = []
        for a in range(0, len(words), 256):
            part = words[a : a + 256]
            ids = np.frombuffer(self.raw([b" \0 ".join(part).decode()])[0], self.dtype)
            data, step = ids.tobytes(), self.dtype.itemsize
            cuts = [-step, *(np.flatnonzero(ids == self.nul) * step).tolist(), len(data)]
            out += [data[p + step : q] for p, q in zip(cuts, cuts[1:], strict=False)]
        return out

    def learn(self, new: list[bytes]) -> None:
        """Put the ids of new words into memory."""
        odd = [w for w in new if len(w) > 256 or SPECIAL in w or NUL in w]
        self.words.update(zip(odd, self.raw([w.decode() for w in odd]), strict=True))
        plain = list(set(new).difference(odd)) if odd else new
        heads = [w.rstrip(MARKS) for w in plain]
        heads = [h if len(h) < len(w) and (h[-1:] in LETTERS or h[-2:] in LETTERS) else w for h, w in zip(heads, plain, strict=True)]
        tails = [w[len(h) :] for h, w in zip(heads, plain, strict=True)]
        known = self.stems
        stems = known.missing(set(heads).union(tails))
        known.update(zip(stems, self.together(stems), strict=True))
        known[b""] = b""
        self.words.update((w, known[h] + known[t]) for w, h, t in zip(plain, heads, tails, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.raw(texts)
        split = [b.split() for b in map(self.folded, texts)]
        flat = list(chain.from_iterable(split))
        found = list(map(self.words.get, flat))
        missed = list(compress(range(len(flat)), map(not_, found)))
        wanted = {flat[i] for i in missed}
        new = self.words.missing(wanted)
        self.learn(new)
        for i in missed:
            found[i] = self.words[flat[i]]
        for w in new:
            if len(w) > LONG_WORD:
                del self.words[w]
        ends = list(accumulate(map(len, split), initial=0))
        return [b"".join(found[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    @staticmethod
    def folded(text: str) -> bytes:
        """UTF-8, with A-Z as a-z where that changes no ids: not beside combining marks, nor in special tokens."""
        b = text.encode()
        return b if SPECIAL in b or any(c in b for c in COMBINING) else b.lower()


_encoders: dict[str, Encoder] = cache()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


FILES = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())])


def encode_shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
    end = np.array([end_id], enc.dtype).tobytes()
    ids: list[int] = []
    data: list[bytes] = []
    size = 0

    def shard() -> pa.RecordBatch:
        own = [np.frombuffer(d, enc.dtype) for d in data]
        file = WaveletMatrix.write(np.concatenate(own), ids, [len(x) for x in own], enc.n_planes)
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([size], pa.int64()), pa.array([file], pa.binary())], schema=FILES)

    for batch in batches:
        own = batch.column(0).fill_null(NO_ID).to_pylist()
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for a, b in blocks(texts, BLOCK):
            for i, d in zip(own[a:b], enc.encode(texts[a:b]), strict=True):
                ids.append(i)
                data.append(d + end)
                size += len(data[-1]) // enc.dtype.itemsize
                if size >= shard_tokens:
                    yield shard()
                    ids, data, size, seq = [], [], 0, seq + 1
    if ids:
        yield shard()


ROWS = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("nth", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def decode_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, file in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            w = WaveletMatrix.read(file)
            ids = memoryview(w.decode().astype("<u4"))
            till = np.cumsum(w.lengths)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip((till - w.lengths).tolist(), till.tolist(), strict=True)]
            n = len(w.doc_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part)), pa.array(np.full(n, seq)), pa.array(w.doc_ids, mask=w.doc_ids == NO_ID), pa.array(np.arange(n)), pa.array(till - w.lengths), pa.array(w.lengths), pa.array(crc, pa.int64())], schema=ROWS
            )


def write_files(docs: DataFrame, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The written table of files (part, seq, n_tokens, file): a wavelet matrix each, in the order of part and seq."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = dealt.mapInArrow(partial(encode_shards, path=path, end_id=end_id, shard_tokens=shard_tokens), "part long, seq long, n_tokens long, file binary")
    return stored(files, "token-files")


def read_rows(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    rows = files.select("part", "seq", "file").mapInArrow(decode_shards, "part long, seq long, doc_id long, nth long, at long, n_tokens long, ids_crc32 long")
    sizes = prefix_sums(files.select("part", "seq", "n_tokens"), [], "part", ["seq"], F.col("n_tokens"), "before").select("part", "seq", "before")
    return rows.join(sizes, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


# --- questions to the files: a shard answers from its planes, no shard is decoded


def header_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, seq, doc_id, from, n_tokens) of the documents of each file."""
    for batch in batches:
        for part, seq, file in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            w = WaveletMatrix.read(file)
            n = len(w.doc_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part)), pa.array(np.full(n, seq)), pa.array(w.doc_ids, mask=w.doc_ids == NO_ID), pa.array(np.cumsum(w.lengths) - w.lengths), pa.array(w.lengths)], names=["part", "seq", "doc_id", "first", "n_tokens"]
            )


def find_batches(batches: Iterator[pa.RecordBatch], tokens: list[int], places: bool) -> Iterator[pa.RecordBatch]:
    """(token, doc_id, at) of each occurrence, or (token, null, how many) of each file."""
    for batch in batches:
        for file in batch.column(2).to_pylist():
            w = WaveletMatrix.read(file)
            till = np.cumsum(w.lengths)
            for t in tokens:
                n = w.count(t)
                if not places:
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([None], pa.int64()), pa.array([n], pa.int64())], names=["token", "doc_id", "at"])
                for a in range(0, n if places else 0, 10_000):
                    found = np.array([w.find(t, k) for k in range(a, min(n, a + 10_000))], np.int64)
                    own = np.searchsorted(till, found, side="right")
                    ids = w.doc_ids[own]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), t)), pa.array(ids, mask=ids == NO_ID), pa.array(found - (till - w.lengths)[own])], names=["token", "doc_id", "at"])


def occurrences(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, doc_id, at): every place of some tokens, from the files' planes."""
    return files.select("part", "seq", "file").mapInArrow(partial(find_batches, tokens=list(tokens), places=True), "token long, doc_id long, at long")


def frequencies(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often some tokens occur, two ranks a plane and file."""
    each = files.select("part", "seq", "file").mapInArrow(partial(find_batches, tokens=list(tokens), places=False), "token long, doc_id long, at long")
    return each.groupBy("token").agg(F.sum("at").alias("n"))


def tokens_at(files: DataFrame, places: DataFrame) -> DataFrame:
    """places (doc_id, at) with the token there; those beyond a document's end, or of no document, are left out.

    Places are joined with the files' headers, then go to the file that holds them. Rows of one doc_id each answer.
    """
    rows = files.select("part", "seq", "file").mapInArrow(header_batches, "part long, seq long, doc_id long, first long, n_tokens long")
    wanted = places.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("at").cast("long").alias("at")).join(rows, "doc_id").where("at >= 0 AND at < n_tokens")

    def answer(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("doc_id", "at", "token")})
        w = WaveletMatrix.read(left.column("file")[0].as_py())
        at = [f + x for f, x in zip(right.column("first").to_pylist(), right.column("at").to_pylist(), strict=True)]
        return pa.table({"doc_id": right.column("doc_id"), "at": right.column("at"), "token": pa.array([w.access(i) for i in at], pa.int64())})

    own = files.select("part", "seq", "file").groupBy("part", "seq")
    return own.cogroup(wanted.select("part", "seq", "doc_id", "first", "at").groupBy("part", "seq")).applyInArrow(answer, "doc_id long, at long, token long")


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_rows(write_files(docs, public_tokenizers.path(TOKENIZER)))
