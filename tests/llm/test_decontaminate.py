import random
import re

import numpy as np

from quarry.llm.decontaminate import contaminated, decontaminated, op6_string_tiling, tile
from tests.conftest import SF


def words(t):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if w]


def brute_tiles(a, b, least=5):
    """Greedy string tiling as its definition has it; the first of equal matches by place."""
    ma, mb, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(a)):
            for q in range(len(b)):
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and p + n not in ma and q + n not in mb:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        if best[0] < least:
            return total
        n, p, q = best
        ma.update(range(p, p + n))
        mb.update(range(q, q + n))
        total += n


def test_tiles_match_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        a, b = [rnd.randrange(3) for _ in range(40)], [rnd.randrange(3) for _ in range(25)]
        seeds = [(p, q) for p in range(36) for q in range(21) if a[p : p + 5] == b[q : q + 5]]
        got = tile(np.array([x[0] for x in seeds], int), np.array([x[1] for x in seeds], int), 5) if seeds else []
        assert all(a[p : p + n] == b[q : q + n] and n >= 5 for p, q, n in got)
        assert sum(t[2] for t in got) == brute_tiles(a, b)


def test_documents_match_brute_force(spark):
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in docs.items()}
    want = {}
    for j, w in items.items():
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for i in docs:
            if len(grams[i] & own) >= 2:
                c = brute_tiles(docs[i], w) if len(docs[i]) < 3000 else None
                if c is None or c >= 0.5 * len(w):
                    want[i, j] = c
    got = {(r.doc_id, r.item_id): r.covered_words for r in op6_string_tiling(spark, SF).collect()}
    assert set(got) == set(want) and len(got) > 0
    assert all(want[k] is None or want[k] == v for k, v in got.items())


def test_edges(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    w = item.split()
    moved = " ".join(w[6:] + ["filler", "filler"] + w[:6])
    rows = [(1, None), (2, ""), (3, item.upper()), (4, f"lead {moved} tail"), (5, "one two three four five and nothing else"), (None, item), (6, "z " * 50_000 + item.replace(" ", ", ")), (6, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "one two", 1), (None, item, 1), (10, item, 1)], "item_id long, text string, doc_id long")
    for size in (16 << 20, 40):
        got = sorted((r.doc_id or 0, r.item_id or 0) for r in contaminated(docs, items, block_bytes=size).collect())
        assert got == [(i, x) for i in (0, 3, 4) for x in (0, 7, 10)] + [(6, x) for x in (0, 0, 7, 7, 10, 10)]
    assert sorted(r.doc_id for r in decontaminated(docs, items).collect()) == [1, 2, 5]
    assert contaminated(docs.limit(0), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0


def test_rows_without_id_are_judged_by_themselves(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(None, item), (None, "clean words without an id"), (None, None), (4, item), (4, "clean words of a repeated id")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = [(r.doc_id, r.text) for r in decontaminated(docs, items).collect()]
    assert sorted(kept, key=str) == sorted([(None, "clean words without an id"), (None, None), (4, "clean words of a repeated id")], key=str)


def test_items_without_id_are_looked_for(spark):
    docs = spark.createDataFrame([(1, "see the quick brown fox jumps over the lazy dog here"), (2, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "the quick brown fox jumps over the lazy dog"), (None, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.covered_words) for r in contaminated(docs, items).collect()] == [(1, None, 9)]
    assert [r.doc_id for r in decontaminated(docs, items).collect()] == [2]


def test_short_items_where_they_are_asked_for(spark):
    docs = spark.createDataFrame([(1, "x one, TWO y"), (2, "two one"), (3, "alpha"), (4, "one two three four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two"), (8, "alpha"), (9, "one two three four five six"), (10, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, items).collect()) == [(4, 9)]
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, items, least_words=1).collect()) == [(1, 7), (3, 8), (4, 7), (4, 9)]


def test_a_phrase_of_all_items_costs_no_more_than_its_seeds(spark):
    import time

    phrase = "in the beginning there was one phrase of all items"
    items = spark.createDataFrame([(i, f"{phrase} and item {i} has words{i} of{i} its{i} own{i}") for i in range(3000)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{phrase} " * 3) for i in range(40)], "doc_id long, text string")
    began = time.time()
    assert contaminated(docs, items).count() == 40 * 3000  # nine of 16 or 17 words
    assert time.time() - began < 120
