"""Two tokenizers' tokens of the same bytes, aligned by relational steps over one row a token.

Both tokenizers cut at spaces, so that equal words align equally: documents are read in blocks, and a block's words have
their tokens once. Runs of words are laid end to end. Tokens are posexploded, their byte lengths summed by a window into
ends, and the two sides met on (run, end): a full outer equi-join by the peers of a window in falling order, since both
sides are keyed by what blocks are dealt by, so that no token is shuffled by itself. Between two neighbouring ends lies
exactly one overlap of a token of each side: the range join for links is the same window, which carries each end's
covering tokens, one row a link, never the pairs of a group. Ends of both sides are cuts; their running count numbers the
groups. A document's links are those of its words, one after the other.

Blocks are bounded and stand in a partition each as far as there are partitions; a task sorts a block's tokens and may
spill. Texts that aren't the sum of their words are one word. Corpus-wide counts come from the distinct pairs of each
document. They are broadcast up to MOST_PAIRS pairs, else joined with hot pairs apart.

Cases: texts null or empty, or whose tokens' bytes on either side aren't those of space and text, have no tokens: zeros
and no digest. A null id is an id. Equal rows are documents of their own. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.token_ids import Memory
from quarry.llm.words import blocks, cache, release
from quarry.operators.joins import hot_join
from quarry.session import ship, stored

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters and documents of a block; partitions that blocks are dealt to; pairs whose counts are broadcast; largest share of hot pairs.
BLOCK, MOST_DOCUMENTS, MOST_PARTS, MOST_PAIRS, HOT_SHARE = 5 << 20, 50_000, 50_000, 2_000_000, 200
#: Words whose ids are kept in each of two generations.
MOST_WORDS = 200_000
#: Words that are laid end to end for the tokens' windows.
RUN = 128
#: Bytes before a word's ids, see joined().
HEAD = 4
#: Ids of one side are below this; an id of the second side has it added.
SIDE = 1 << 16
#: White space on both sides of a space: a token of the byte level may reach across it.
ACROSS = re.compile(r"\s \s")


def byte_values() -> dict[str, int]:
    """The byte of each character that a byte-level entry is written in: printable ones stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def joined(a: bytes, b: bytes) -> bytes:
    """The 16-bit ids of both sides, behind how many the first has, in HEAD bytes."""
    return (len(a) // 2).to_bytes(HEAD, "little") + a + b


class Tokenizers:
    """Ids of both sides, a word with the space before it at a time.

    Both cut before a space that follows other characters: the first side's pattern starts a token there unless white
    space surrounds the space, no piece of the second has a space mark behind other characters. Texts in which that
    doesn't hold are encoded whole.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        values = byte_values()
        names = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        size = names[-1][1] + 1
        self.bytes_a = [b""] * size
        for name, i in names:
            self.bytes_a[i] = bytes(values[c] for c in name) if all(c in values for c in name) else name.encode()
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.lengths_a, self.lengths_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        if max(size, len(self.bytes_b)) > SIDE:
            raise ValueError("vocabularies of more than 65,536 entries need wider ids")
        self.by_word = not any(re.search("[^▁]▁", piece(i)) for i in range(len(self.bytes_b)))
        self.known = Memory(MOST_WORDS)

    def whole(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both sides of a space and each text, as 16-bit integers; None where the bytes differ."""
        out: list[tuple[bytes, bytes] | None] = []
        for t, a, b in zip(texts, self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1), strict=True):
            want = b" " + t.encode()
            same = b"".join([self.bytes_a[i] for i in a.ids]) == want and b"".join([self.bytes_b[i] for i in b]) == want
            out.append((np.array(a.ids, np.uint16).tobytes(), np.array(b, np.uint16).tobytes()) if same and t else None)
        return out

    def learn(self, new: list[str]) -> None:
        """Keep the ids of new words: many are encoded in one text and parted where the bytes of a word end."""
        odd = [w for w in new if not w or w[0].isspace() or w[-1].isspace() or " " in w or len(w) > 200]
        plain = list(set(new).difference(odd)) if odd else new
        for a in range(0, len(plain), 256):
            words = plain[a : a + 256]
            text = " ".join(words)
            want, ends = b" " + text.encode(), np.cumsum([len(w.encode()) + 1 for w in words])
            sides = []
            for listed, names, lengths in ((self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.bytes_a, self.lengths_a), (self.b.encode(text, num_threads=1), self.bytes_b, self.lengths_b)):
                ids = np.array(listed, np.uint16)
                till = np.cumsum(lengths[ids])
                cut = np.searchsorted(till, ends)
                if b"".join([names[i] for i in listed]) == want and (till[cut] == ends).all():
                    data, cut = ids.tobytes(), [0, *((cut + 1) * 2).tolist()]
                    sides.append([data[i:j] for i, j in zip(cut, cut[1:], strict=False)])
            if len(sides) == 2:
                self.known.update(zip(words, map(joined, *sides), strict=True))
            else:
                odd += words
        for a in range(0, len(odd), 256):
            self.known.update((w, f and joined(*f)) for w, f in zip(odd[a : a + 256], self.whole(odd[a : a + 256]), strict=True))

    def words(self, text: str) -> list[str]:
        """The words of a text, or the text alone where its ids aren't those of its words."""
        # a space at an edge or beside another has no place among the second side's pieces unless the library gives it one
        if not self.by_word or "  " in text or text[:1] == " " or text[-1:] == " " or ACROSS.search(text):
            return [text]
        return text.split(" ")

    def ids(self, words: Iterable[str]) -> list[bytes | None]:
        """whole() of what words() gives, joined, kept for the next call."""
        self.learn(self.known.missing(set(words)))
        return list(map(self.known.__getitem__, words))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """whole() of texts, by words where that gives the same."""
        out: list[tuple[bytes, bytes] | None] = []
        for found in (self.ids(self.words(t)) for t in texts):
            ends = [None if f is None else HEAD + 2 * int.from_bytes(f[:HEAD], "little") for f in found]
            out.append(None if None in found else tuple(b"".join([f[x] for f, x in zip(found, at, strict=True)]) for at in ([slice(HEAD, e) for e in ends], [slice(e, None) for e in ends])))
        return out


_kept: dict[tuple[str, str], Tokenizers] = cache()


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    if (path_a, path_b) not in _kept:
        _kept[path_a, path_b] = Tokenizers(path_a, path_b)
    return _kept[path_a, path_b]


#: Rows of documents (k: their place in block p), one of how many ids of the first side each word has (k: -1), and of runs of RUN words laid end to end (k: the run's number); ids of both sides are 16-bit integers less 32,768, n_a of the first.
PARTS = pa.schema([("p", pa.int64()), ("k", pa.int64()), ("document", pa.bool_()), ("doc_id", pa.int64()), ("numbers", pa.binary()), ("n_a", pa.int32()), ("ids", pa.list_(pa.int16()))])
PARTS_DDL = "p long, k long, document boolean, doc_id long, numbers binary, n_a int, ids array<short>"


class Numbers(dict):
    """A number for each word, in the order they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def packed(numbers: array | np.ndarray) -> bytes:
    """32-bit numbers, compressed by planes of bytes, the length before them."""
    planes = np.frombuffer(numbers, np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def block_batches(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """Rows of PARTS of (doc_id, text), a block of documents after the other."""
    both, part = tokenizers(path_a, path_b), TaskContext.get().partitionId() << 32
    block, doc_ids, docs, size = Numbers(), [], [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        found = both.ids(block)
        good = np.array([f is not None for f in found], bool)
        numbers = [packed(d) if len(d) and good[np.frombuffer(d, np.uint32)].all() else None for d in docs]
        each = np.frombuffer(b"".join([bytes(HEAD) if f is None else f[:HEAD] for f in found]), "<u4")
        n = len(docs) + 1
        none = lambda i, n: pa.nulls(n, PARTS.types[i])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.arange(-1, n - 1)), pa.array(np.ones(n, bool)), pa.array([None, *doc_ids], pa.int64()), pa.array([packed(each), *numbers], pa.binary()), none(5, n), none(6, n)], schema=PARTS)
        found, each = [f for f in found if f is not None], each[good]
        for start in range(0, len(found), 512 * RUN):
            words, n_a = found[start : start + 512 * RUN], each[start : start + 512 * RUN]
            till = (HEAD + 2 * n_a).tolist()
            data = [(b"".join([w[HEAD:e] for w, e in zip(words[i : i + RUN], till[i : i + RUN], strict=True)]), b"".join([w[e:] for w, e in zip(words[i : i + RUN], till[i : i + RUN], strict=True)])) for i in range(0, len(words), RUN)]
            n = len(data)
            values = np.frombuffer(b"".join(chain.from_iterable(data)), np.uint16) ^ np.uint16(1 << 15)
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *((len(x) + len(y)) // 2 for x, y in data)]), pa.int32()), pa.array(values.view(np.int16)))
            k = np.arange(n) + start // RUN
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(k), pa.array(np.zeros(n, bool)), none(3, n), none(4, n), pa.array([len(x) // 2 for x, _ in data], pa.int32()), ids], schema=PARTS)

    for batch in batches:
        for start in range(0, batch.num_rows, 1_000):
            piece = batch.slice(start, 1_000)
            for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                docs.append(array("I", map(block.__getitem__, both.words(text)) if text else ()))
                size += len(text or "")
                if size >= BLOCK or len(docs) >= MOST_DOCUMENTS:
                    yield from rows()
                    block, doc_ids, docs, size, part = Numbers(), [], [], 0, part + 1
    if docs:
        yield from rows()


def links(runs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row a link of runs (p, k, n_a, ids) of PARTS: (p, k, end, a, b, a_ends, b_ends).

    a and b are the ids of the tokens that overlap up to end, a_ends and b_ends tell which of them ends there. Rows are sorted by p, k and falling end within their partitions, by p of which runs are dealt already.
    """
    both = tokenizers(path_a, path_b)
    lengths = pa.table({"code": pa.array([*range(len(both.bytes_a)), *range(SIDE, SIDE + len(both.bytes_b))], pa.int32()), "length": pa.array([*map(len, both.bytes_a), *map(len, both.bytes_b)], pa.int32())})
    tokens = runs.select("p", "k", "n_a", F.posexplode("ids").alias("at", "id")).withColumn("side", F.col("at") >= F.col("n_a"))
    tokens = tokens.withColumn("code", F.col("side").cast("int") * SIDE + F.col("id") + (1 << 15))
    tokens = tokens.join(F.broadcast(runs.sparkSession.createDataFrame(lengths)), "code")
    so_far = Window.partitionBy("p", "k", "side").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = tokens.select("p", "k", "side", "code", F.sum("length").over(so_far).cast("int").alias("end"))
    # the frame holds all rows of the same end, so that both sides' tokens meet there; one row an end goes on
    back = Window.partitionBy("p", "k").orderBy(F.desc("end")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    of_a, of_b = ~F.col("side"), F.col("side")
    last = lambda of, c: F.last(F.when(of, c), ignorenulls=True).over(back)
    met = ends.select("p", "k", "side", "end", last(of_a, F.col("code")).alias("a"), (last(of_b, F.col("code")) - SIDE).alias("b"), last(of_a, F.col("end")).alias("end_a"), last(of_b, F.col("end")).alias("end_b"))
    met = met.where(of_a | (F.col("end_a") != F.col("end")) | F.col("end_a").isNull())
    return met.select("p", "k", "end", "a", "b", F.coalesce(F.col("end_a") == F.col("end"), F.lit(False)).alias("a_ends"), F.coalesce(F.col("end_b") == F.col("end"), F.lit(False)).alias("b_ends"))


DOCUMENTS = pa.schema([
    ("p", pa.int64()), ("k", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
])
DOCUMENTS_DDL = "p long, k long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<int>"


def cells() -> tuple[np.ndarray, np.ndarray]:
    """(bytes, their number) of each id with a comma behind it, then of each with a bar, then with a semicolon; zeros fill up."""
    rows = [f"{i}{mark}".encode() for mark in ",|;" for i in range(SIDE)]
    return np.array(rows, "S6").view(np.uint8).reshape(-1, 6), np.fromiter(map(len, rows), np.int32, len(rows))


def groups(first: np.ndarray, a: np.ndarray, b: np.ndarray, ends: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[list[bytes], list[np.ndarray]]:
    """The written groups of each word of whole words' links in the order of their ends, and its numbers of tokens, groups and links; ends: 1 where a ends, 2 where b, 3 where both.

    Groups are written token by token: an id of the first side stands behind all of both sides' groups before its own,
    one of the second side behind its group's first side too.
    """
    cut = ends == 3
    group = np.cumsum(cut, dtype=np.int32) - cut
    at_a, at_b = np.flatnonzero(ends & 1), np.flatnonzero(ends & 2)
    n = int(cut.sum())
    till_a, till_b = (np.cumsum(np.bincount(group[at], minlength=n)) for at in (at_a, at_b))
    before_b = np.concatenate(([0], till_b[:-1]))
    ids = np.empty(len(at_a) + len(at_b), np.int32)
    ids[np.arange(len(at_a)) + before_b[group[at_a]]] = a[at_a] + SIDE * cut[at_a]
    ids[np.arange(len(at_b)) + till_a[group[at_b]]] = b[at_b] + 2 * SIDE * cut[at_b]
    marks, lengths = table
    text = marks[ids].tobytes().translate(None, b"\0")
    del group, at_a, at_b
    sums = [np.add.reduceat(x.astype(np.int64), first) for x in (ends & 1, (ends & 2) >> 1, cut, np.ones(len(a), np.int64))]
    till = np.concatenate(([0], np.cumsum(lengths[ids], dtype=np.int64)))[np.cumsum(np.concatenate(([0], sums[0] + sums[1])))].tolist()
    return [text[i : j - 1] for i, j in zip(till, till[1:], strict=False)], sums


_cells: dict[str, tuple[np.ndarray, np.ndarray]] = cache()


def digests(docs: pa.Table, found: pa.Table) -> pa.Table:
    """DOCUMENTS of a block's documents, from its words' links: those of a document are those of its words, one after the other."""
    if _kept or not _cells:
        release()
        _cells["cells"] = cells()
    head = pc.equal(docs.column("k"), -1)
    of_word, docs = unpacked(docs.filter(head).column("numbers")[0].as_py()), docs.filter(pc.invert(head))
    blank = docs.column("numbers").is_null().to_numpy()
    own = [unpacked(x) for x in docs.column("numbers").drop_null().to_pylist()]
    n = docs.num_rows
    sums, shas = [np.zeros(n, np.int64) for _ in range(4)], np.full(n, "", object)
    till, pairs, counts = np.zeros(n, np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    if own:
        order = np.lexsort((found.column("end").to_numpy(), found.column("k").to_numpy())).astype(np.int32)
        a, b, ends = (found.column(c).to_numpy()[order] for c in ("a", "b", "ends"))
        del order
        # a word ends with the last of its tokens of the first side; words without tokens have none
        place = np.cumsum(of_word > 0) - 1
        last = np.flatnonzero(ends & 1)[np.cumsum(of_word[of_word > 0], dtype=np.int64) - 1]
        first = np.concatenate(([0], last[:-1] + 1))
        texts, of_words = groups(first, a, b, ends, _cells["cells"])
        del ends
        pair = (a.astype(np.int64) << 16) | b
        del a, b
        known = np.unique(pair)
        nth = np.searchsorted(known, pair).astype(np.int32)
        del pair
        good = np.flatnonzero(~blank)
        for i, j in blocks(own, 1 << 17):
            at = place[np.concatenate(own[i:j])]
            starts = np.cumsum([0, *map(len, own[i : j - 1])])
            for total, x in zip(sums, of_words, strict=True):
                total[good[i:j]] = np.add.reduceat(x[at], starts)
            cuts = [*starts.tolist(), len(at)]
            each = list(map(texts.__getitem__, at.tolist()))
            shas[good[i:j]] = [hashlib.sha256(b";".join(each[x:y])).hexdigest() for x, y in zip(cuts, cuts[1:], strict=False)]
            size = of_words[3][at]
            spread = np.arange(int(size.sum())) + np.repeat(first[at] - np.cumsum(size) + size, size)
            owner = np.repeat(np.arange(j - i), sums[3][good[i:j]])
            keys, times = np.unique(owner * len(known) + nth[spread], return_counts=True)
            pairs.append(known[keys % len(known)])
            counts.append(times.astype(np.int32))
            till[good[i:j]] = np.bincount(keys // len(known), minlength=j - i)
    offsets = pa.array(np.concatenate(([0], np.cumsum(till))), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (pairs, counts)]
    return pa.Table.from_arrays([*(docs.column(c) for c in ("p", "k", "doc_id")), *map(pa.array, sums), pa.array(shas, pa.string()), *lists], schema=DOCUMENTS)


def dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows of PARTS and a number of partitions, with p changed for numbers that hashing by p deals to a partition each."""
    spark = rows.sparkSession
    found = [r.p for r in rows.where("document AND k = 0").select("p").collect()]
    parts = min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(found)))
    slots = spark.range(0, 20 * parts, 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("slot")).agg(F.min("id").alias("id")).collect()
    free = sorted(r.id for r in slots)
    names = [(p, free[i % len(free)] + i // len(free) * 20 * parts) for i, p in enumerate(sorted(found))]
    return rows.join(F.broadcast(spark.createDataFrame(names, "p long, name long")), "p").withColumn("p", F.col("name")).drop("name"), parts


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs' rows as (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks_of = stored(docs.mapInArrow(partial(block_batches, path_a=path_a, path_b=path_b), PARTS_DDL), "aligned-blocks", compression="zstd")
    blocks_of, parts = dealt(blocks_of)
    runs = blocks_of.where("NOT document").select("p", "k", "n_a", "ids").repartition(parts, "p")
    rows = links(runs, path_a, path_b).select("p", "k", "end", "a", "b", (F.col("a_ends").cast("int") + 2 * F.col("b_ends").cast("int")).alias("ends"))
    # columns of their own: both sides come from one table
    whole = blocks_of.where("document").select(*[F.col(c).alias(c) for c in ("p", "k", "doc_id", "numbers")]).repartition(parts, "p")
    found = stored(whole.groupBy("p").cogroup(rows.groupBy("p")).applyInArrow(digests, DOCUMENTS_DDL), "aligned")
    each = found.select("p", "k", F.posexplode("pairs").alias("at", "pair"), "counts").select("p", "k", "pair", F.col("counts")[F.col("at")].cast("long").alias("n"))
    counts = stored(each.groupBy("pair").agg(F.sum("n").alias("total"), F.count("*").alias("rows")).withColumn("b", F.col("pair").bitwiseAND(SIDE - 1)), "aligned-pairs")
    best = counts.groupBy("b").agg(F.max("total").alias("most"))
    counts = counts.join(F.broadcast(best), "b").select("pair", "total", "rows", (F.col("total") == F.col("most")).alias("best"))
    n_pairs, n_rows = counts.agg(F.count("*"), F.sum("rows")).first()
    if n_pairs <= MOST_PAIRS:
        met = each.join(F.broadcast(counts.drop("rows")), "pair")
    else:
        met = hot_join(each, counts, ["pair"], "rows", F.xxhash64("p", "k"), max(1, n_rows // HOT_SHARE))
    sums = met.groupBy("p", "k").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    out = found.drop("pairs", "counts").join(sums, ["p", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return aligned(docs, public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))
