"""Benchmark decontamination by greedy string tiling.

Word runs of the seed's length, shared by a document and a test item, are joined by a Karp-Rabin hash over word hashes
and confirmed word by word. Seeds on one diagonal grow into matches; the longest match whose words are free is marked, again and again, so that
passages in another order are found too. A pair counts where its tiles cover enough of the item.

The test items are worked on in blocks of at most BLOCK_BYTES, each broadcast by itself: all items against all rows.

Cases: a null text has no words. An item of fewer words than a seed is never found, unless least_words asks for
it: then where all of it stands in a row. Equal items are found each. A document or an item without id is judged all the
same, and its pairs have a null there. An empty table of documents or items gives no pairs. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.words import PUNCT, blocks, grams, hashed, release
from quarry.session import ship

SEED_WORDS, COVERAGE = 5, 0.5
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, n_item_words long, covered_words long, n_tiles long, longest_tile long"
PAIRS = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def tile(at_doc: np.ndarray, at_item: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the document, in the item, words) of greedy string tiling, from the places of shared seeds."""
    order = np.lexsort((at_item, at_doc - at_item))
    d, i = at_doc[order], at_item[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(d - i) != 0) | (np.diff(i) != 1))))
    runs = np.diff(np.concatenate((new, [len(d)]))) + seed - 1
    heap = [(-int(n), int(d[k]), int(i[k])) for k, n in zip(new, runs, strict=True)]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    tiles = []
    while heap:
        n, p, q = heapq.heappop(heap)
        free = [p + k not in in_doc and q + k not in in_item for k in range(-n)]
        if all(free):
            tiles.append((p, q, -n))
            in_doc.update(range(p, p - n))
            in_item.update(range(q, q - n))
            continue
        k = 0
        while k < -n:  # what is left of a match that has met a longer one
            if not free[k]:
                k += 1
                continue
            e = k
            while e < -n and free[e]:
                e += 1
            if e - k >= seed:
                heapq.heappush(heap, (k - e, p + k, q + k))
            k = e
    return tiles


def words_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    return hashed([(t or "").lower().encode() for t in texts], PUNCT)


class Seeds:
    """Seeds of test items by length: items of fewer words than a seed, from least words on, are seeds of their own length."""

    def __init__(self, ids: list, texts: list, seed: int, least: int):
        self.words, self.at = words_of(texts)
        self.ids, self.n = ids, np.diff(self.at)
        self.tables = []
        for k in sorted({min(seed, n) for n in self.n.tolist() if n >= max(1, least)}):
            g = grams(self.words, k)
            item = np.repeat(np.arange(len(texts)), self.n)[: len(g)]
            place = np.arange(len(g)) - self.at[item]
            ok = (place + k <= self.n[item]) & (np.minimum(self.n[item], seed) == k)
            order = np.flatnonzero(ok)[np.argsort(g[ok], kind="stable")]
            keys, first = np.unique(g[order], return_index=True)
            self.tables.append((k, keys, np.append(first, len(order)), item[order], place[order]))


def shared(h: np.ndarray, at: np.ndarray, seeds: Seeds) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(document, item, length, places in the document, in the item) of the seeds that both have, word by word."""
    for k, keys, first, item, place in seeds.tables:
        g = grams(h, k)
        where = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        hit = np.flatnonzero(keys[where] == g)
        doc = np.searchsorted(at, hit, side="right") - 1
        inside = hit + k <= at[doc + 1]
        hit, doc = hit[inside], doc[inside]
        n = first[where[hit] + 1] - first[where[hit]]
        s = np.repeat(first[where[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        hit, doc, x, q = np.repeat(hit, n), np.repeat(doc, n), item[s], place[s]
        same = np.ones(len(hit), bool)
        for j in range(k):  # equal hashes of runs are confirmed on the words
            same &= h[hit + j] == seeds.words[seeds.at[x] + q + j]
        order = np.flatnonzero(same)
        order = order[np.lexsort((x[order], doc[order]))]
        hit, doc, x, q = hit[order], doc[order], x[order], q[order]
        cuts = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(x) != 0), [True]))) if len(doc) else []
        for c, e in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(doc[c]), int(x[c]), k, hit[c:e] - at[doc[c]], q[c:e]


def find(batches: Iterator[pa.RecordBatch], table, seed: int, coverage: float) -> Iterator[pa.RecordBatch]:
    release()
    seeds: Seeds = table.value
    for batch in batches:
        docs = batch.column(0).to_pylist()
        texts = [(t or "").lower().encode() for t in batch.column(1).to_pylist()]
        out: list[tuple] = []
        for a, b in blocks(texts):
            for doc, x, k, p, q in shared(*hashed(texts[a:b], PUNCT), seeds):
                tiles = tile(p, q, k)
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * seeds.n[x]:
                    out.append((docs[a + doc], seeds.ids[x], int(seeds.n[x]), covered, len(tiles), max(t[2] for t in tiles)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6, schema=PAIRS)


def contaminated(docs: DataFrame, items: DataFrame, seed: int = SEED_WORDS, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, least_words: int = SEED_WORDS) -> DataFrame:
    """Pairs (doc_id, item_id) with their tiles, where these cover at least that share of the item's words.

    Items of fewer than least_words words are not looked for: a run of two or three words is no evidence of a benchmark.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_blocks = -(-total // block_bytes) * (2 if total > block_bytes else 1)
    found = []
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        got = block.toArrow()  # at most about block_bytes
        table = spark.sparkContext.broadcast(Seeds(got.column(0).to_pylist(), got.column(1).to_pylist(), seed, least_words))
        found.append(docs.mapInArrow(partial(find, table=table, seed=seed, coverage=coverage), SCHEMA))
    if not found:
        return spark.createDataFrame([], SCHEMA).withColumn("coverage", F.lit(0.0))
    return reduce(DataFrame.unionByName, found).withColumn("coverage", F.col("covered_words") / F.col("n_item_words"))


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without the documents that hold enough of a test item.

    Rows are told apart by a hash of id and text, so that a row without id, or of a repeated id, is judged by itself.
    """
    row = F.xxhash64("doc_id", "text")
    bad = contaminated(docs.select(row.alias("doc_id"), "text"), items, **how).select(F.col("doc_id").alias("_row")).distinct()
    return docs.join(bad, row == F.col("_row"), "left_anti")
