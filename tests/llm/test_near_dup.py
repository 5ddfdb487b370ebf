import random
import re

import pytest

from quarry.llm import near_dup
from quarry.llm.near_dup import deduplicated, near_duplicates, op5_minhash_near_dup
from tests.conftest import SF


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, k=4):
    ids = sorted(texts)
    sets = {i: shingles(texts[i], k) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = {}
    for i in ids:
        for s in sets[i]:
            inverted.setdefault(s, []).append(i)
    common = {}
    for v in inverted.values():
        for a in range(len(v)):
            for b in range(a + 1, len(v)):
                common[v[a], v[b]] = common.get((v[a], v[b]), 0) + 1
    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(df, texts, k=4):
    want = brute(texts, k)
    got = near_duplicates(df, k).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)
    return got


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    got = check(df, texts)
    assert any(not r.kept for r in got)
    assert sorted((r.doc_id, r.component_id) for r in op5_minhash_near_dup(spark, SF).collect()) == sorted((r.doc_id, r.component_id) for r in got)


@pytest.mark.parametrize("small", [12, 10_000])
def test_chains_and_edges(spark, small, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "SIDE", 60)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = {1: None, 2: "", 3: "  \n", 4: "Alpha beta", 5: "alpha\tBETA ", 6: "alpha beta gamma", 7: "x\xa0y one two three", 8: "X\xa0y one two three"}
    at = 10
    for _ in range(12):  # chains of small edits: the ends are less alike than neighbours
        t = [rnd.choice(words) for _ in range(60)]
        for _ in range(10):
            texts[at] = " ".join(t)
            t[rnd.randrange(len(t))] = rnd.choice(words)
            at += rnd.randrange(1, 4)
    base = [rnd.choice(words) for _ in range(150)]
    for i in range(260):  # a hub of near copies, some of them linked with few others or none
        t = list(base)
        for _ in range(rnd.choice((1, 2, 3, 4, 6, 8))):
            t[rnd.randrange(150)] = rnd.choice(words)
        texts[at] = " ".join(t)
        at += 1
    texts[at] = "long " + " ".join(rnd.choice(words) for _ in range(60_000))
    df = spark.createDataFrame([(i, "c", t) for i, t in texts.items()], "doc_id long, bands string, text string")
    check(df, texts)
    check(df, texts, 5)
    kept = deduplicated(df).collect()
    want = brute(texts, 5)
    assert sorted(r.doc_id for r in kept) == sorted(i for i, (_, c) in want.items() if i == c)
    assert near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(twice).collect()) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_rows_without_id_stay(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (None, text), (None, "other words of one row"), (3, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in deduplicated(df).collect()) == [(0, text), (0, text), (0, "other words of one row"), (2, text)]


def test_rows_of_one_id_with_other_texts_are_judged_apart(spark):
    a, b = "a b c d e f g h", "totally other words of quite another row"
    df = spark.createDataFrame([(1, a), (1, b), (1, b), (2, a), (3, b), (None, a), (4, None), (4, "")], "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text or "") for r in deduplicated(df).collect()))
    assert kept == [(0, a), (1, a), (1, b), (4, ""), (4, "")]
    assert deduplicated(df.limit(0)).count() == 0


def test_hot_classes_and_buckets(spark, monkeypatch):
    """A class of exact copies and a bucket of near copies hold a third of the rows each, whatever counts as hot."""
    rnd = random.Random(9)
    base = [rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randrange(1, 9) for _ in range(200)]
    texts = {i: "one text that all these documents share word for word" for i in range(300)}
    for i in range(300, 600):
        w = list(base)
        w[rnd.randrange(200)] = f"x{i}"
        texts[i] = " ".join(w)
    texts |= {i: " ".join(f"w{rnd.randrange(9999)}" for _ in range(12)) for i in range(600, 900)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for share in (200, 2, 900):
        monkeypatch.setattr(near_dup, "HOT_SHARE", share)
        check(df, texts)
