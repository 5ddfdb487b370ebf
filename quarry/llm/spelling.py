"""Spelling variants: words one inserted, deleted or replaced code point apart, by hashes of their deletions.

A word of L code points has L + 1 keys: its own hash and that of the word without each of its code points, which is a
polynomial prefix hash plus a suffix hash moved down by one place; NumPy makes them for a whole batch from one running
sum. Rows are dealt by the keys' leading bits and sorted by key; rows of one key are compared as strings, so collisions
of hashes change nothing. Two words differ by one replacement if they are equal without the same place, which holds at
one place only; one is the other without a code point if its own key meets a deletion of the other, of which those in a
run of equal code points count once. So each near pair meets exactly once, and a group gives each of its words the number
and the best of the others without making pairs. A group has at most one row for each place and letter of the alphabet
that words are made of, so that no group grows with the corpus.

Cases: a null or empty text has no words. A null id counts as "null" in what is hashed with it. Equal rows count each. No
words give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.words import mix, powers
from quarry.session import remove_path, shared_path, ship, stored

LEAST_LENGTH, LEAST_N, RATIO, SLIP = 7, 2, 10, 31
#: Words that a task counts before it hands their numbers on; leading bits of keys; rounds of following forms, an error beyond.
MOST_COUNTED, RADIX_BITS, MOST_ROUNDS = 400_000, 12, 12

COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
KEYS = pa.schema([("key", pa.int64()), ("place", pa.int32()), ("first", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])
NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def slipped(run: str, doc_prefix: int, slip: int | None) -> str:
    """run, or run without a code point where slip divides the hash of "<doc_id>:<run>"; doc_prefix is that of "<doc_id>:"."""
    if slip:
        h = zlib.crc32(run.encode(), doc_prefix)
        if h % slip == 0:
            return run[: h % len(run)] + run[h % len(run) + 1 :]
    return run


def count_batches(batches: Iterator[pa.RecordBatch], least_length: int, slip: int | None) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=COUNTS)
        total.clear()
        return rows

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            prefix = zlib.crc32(b"null:" if doc_id is None else b"%d:" % doc_id)
            # lower() of bytes changes A-Z alone
            for run, n in Counter(runs.findall(text.encode().lower().decode())).items():
                word = slipped(run, prefix, slip)
                if len(word) >= least_length:
                    total[word] += n
            if len(total) > MOST_COUNTED:
                yield out()
    if total:
        yield out()


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, slip: int | None = None) -> DataFrame:
    """(word, n): runs of letters of docs (doc_id, text) with at least least_length code points, A-Z as a-z.

    With slip, a run loses a code point where slip divides a hash of it and its document's id.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    part = docs.mapInArrow(partial(count_batches, least_length=least_length, slip=slip), "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first of its run, index of the word) of all keys; place is -1 for the word's own."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    up, down = powers(len(points) + 2)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * up[: len(points)], dtype=np.uint64, out=total[1:])
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(points))
    prefix = (total[:-1] - total[starts[owner]]) * down[starts[owner]]
    suffix = (total[ends[owner]] - total[1:]) * down[starts[owner] + 1]
    whole = (total[ends] - total[starts]) * down[starts]
    size = np.concatenate((lengths, lengths[owner] - 1)).astype(np.uint64)
    key = mix(np.concatenate((whole, prefix + suffix)) + size * np.uint64(0x9E3779B97F4A7C15))
    first = np.ones(len(points), bool)
    first[1:] = (points[1:] != points[:-1]) | (owner[1:] != owner[:-1])
    place = np.concatenate((np.full(len(words), -1), at - starts[owner]))
    return key.view(np.int64), place, np.concatenate((np.ones(len(words), bool), first)), np.concatenate((np.arange(len(words)), owner))


def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 20_000):
            rows = batch.slice(a, 20_000)
            key, place, first, owner = deletion_keys(rows.column(0).to_pylist())
            owner = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place, pa.int32()), pa.array(first), rows.column(0).take(owner), rows.column(1).take(owner)], schema=KEYS)


class Near:
    """What the words of sorted groups have beside them, as columns."""

    def __init__(self) -> None:
        self.rows: tuple[list, list, list, list] = ([], [], [], [])

    def add(self, word: str, n_near: int, best: tuple[int, str]) -> None:
        for column, value in zip(self.rows, (word, n_near, -best[0], best[1]), strict=True):
            column.append(value)

    def group(self, own: tuple[int, str] | None, cut: list[tuple[int, bool, tuple[int, str]]]) -> None:
        """Words that give one string: own is it, cut are those that are it without a code point. Words are (-n, word)."""
        places = defaultdict(list)
        for place, _, word in cut:
            places[place].append(word)
        for words in places.values():
            if len(words) > 1:
                best, second = sorted(words)[:2]
                for word in words:
                    self.add(word[1], len(words) - 1, second if word == best else best)
        longer = [word for _, first, word in cut if first]
        if own and longer:
            self.add(own[1], len(longer), min(longer))
            for word in longer:
                self.add(word[1], 1, own)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, NEAR, strict=True)], schema=NEAR)


def near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of KEYS sorted by key; the last key's rows wait for the next batch."""
    near, kept = Near(), None

    def work(rows: pa.RecordBatch) -> None:
        key = rows.column(0).to_numpy()
        same = np.flatnonzero(key[1:] == key[:-1])
        shared = np.union1d(same, same + 1)
        if not len(shared):
            return
        cols = [rows.column(i).take(pa.array(shared)).to_pylist() for i in range(5)]
        groups: dict[tuple[int, str], tuple[list, list]] = {}
        for k, place, first, word, n in zip(*cols, strict=True):
            text = word if place < 0 else word[:place] + word[place + 1 :]
            own, cut = groups.setdefault((k, text), ([], []))
            if place < 0:
                own.append((-n, word))
            else:
                cut.append((place, first, (-n, word)))
        for own, cut in groups.values():
            near.group(own[0] if own else None, cut)

    for batch in batches:
        rows = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        key = rows.column(0).to_numpy()
        end = int(np.searchsorted(key, key[-1]))
        work(rows.slice(0, end))
        kept = rows.slice(end)
        if near.rows[0]:
            yield near.taken()
    if kept is not None:
        work(kept)
        if near.rows[0]:
            yield near.taken()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of each of words (word, n; distinct words) that has a near one: near has the largest n."""
    ship(words.sparkSession)
    keys = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(key_batches, "key long, place int, first boolean, word string, n long")
    dealt = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    found = dealt.mapInArrow(near_batches, "word string, n_near long, near_n long, near string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("by"), "near")).alias("_best"))
    return best.select("word", "n_near", F.col("_best.near").alias("near"), (-F.col("_best.by")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form): the end of each chain, found by doubling; a form's n is larger, so there are no circles."""
    spark = forms.sparkSession
    at = shared_path(spark, "roots")
    forms.select("word", F.col("form").alias("root")).write.parquet(at)
    for _ in range(MOST_ROUNDS):
        now = spark.read.parquet(at)
        on = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        path = shared_path(spark, "roots")
        now.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")).write.parquet(path)
        remove_path(spark, at)
        at, out = path, spark.read.parquet(path)
        if out.where("moved").isEmpty():
            return out.select("word", "root")
    raise RuntimeError("forms did not settle")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words (word, n) with form, root, n_near and form_n: form is the near word of largest n, if that is ratio times the word's."""
    words = stored(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "spelling-words")
    has = F.col("near_n") >= F.lit(ratio) * F.col("n")
    near = words.join(near_words(words), "word", "left")
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "spelling-near")
    out = near.join(roots(near.where("form IS NOT NULL").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variants(word_counts(docs, slip=SLIP).where(F.col("n") >= LEAST_N))
