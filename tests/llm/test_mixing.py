import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm.mixing import mix, op10_mix_sources, repeated
from tests.conftest import SF


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, done = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in done]
        left = total - sum(done.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 2.0 * sizes[s] for s in over}


def check(rows, slack=True):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    want = brute_targets({s: sum(r["size"] for r in x) for s, x in by.items()})
    for s, x in by.items():
        largest = max(r["size"] for r in x)
        taken = sum(r.taken for r in x)
        assert x[0].target == pytest.approx(want[s])
        assert abs(taken - want[s]) <= largest / 2 + 1e-6
        for r in x:
            assert 0 <= r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)


def test_targets_and_sums(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = mix(docs).collect()
    assert len(rows) == len(texts)
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])) for r in rows)
    check(rows)
    key = lambda x: sorted((r.doc_id, r.taken) for r in x)
    assert key(op10_mix_sources(spark, SF).collect()) == key(rows) == key(mix(docs.repartition(7), bin_rows=13).collect())


def test_edges(spark):
    rows = [(1, None, None), (2, None, "a b c"), (3, "x", ""), (4, "é", "a " * 500), (4, "é", "a " * 500), (5, "b", "q\x0bz k"), (6, "hot", "w " * 40)] + [(10 + i, "hot", f"t{i} " * 9) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    got = mix(df).collect()
    assert len(got) == len(rows)
    check(got)
    assert next(r for r in got if r.doc_id == 1).taken == 0
    assert mix(df.limit(0)).count() == 0
    again = repeated(df.drop("size"))
    assert again.columns == ["doc_id", "source", "text"]
    assert again.where("source = 'hot'").count() == sum(r.taken // r["size"] for r in got if r.source == "hot")


def test_better_documents_come_first(spark):
    rows = [(i, "a", "w " * 20 if i % 2 else "w# " * 20) for i in range(4000)] + [(i, "b", "w " * 20) for i in range(4000, 5000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(1, 9), share=0.5).collect()
    clean = sum(r.taken > 0 for r in got if r.source == "a" and r.doc_id % 2)
    dirty = sum(r.taken > 0 for r in got if r.source == "a" and not r.doc_id % 2)
    assert clean > 2 * dirty > 0


def test_rows_without_id(spark):
    rows = [(None, "a", f"t{i} " * (1 + i % 9)) for i in range(600)] + [(i, "b", f"u{i} " * 9) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mix(df, share=0.5, bin_rows=20).collect()
    check_share = {s: sum(r.taken for r in got if r.source == s) for s in "ab"}
    for r in got:
        assert abs(check_share[r.source] - r.target) <= 4.5
    again = repeated(df, share=0.5).collect()
    assert sum(len(r.text.split()) for r in again if r.source == "a") == sum(r.taken for r in mix(df, share=0.5).collect() if r.source == "a")


def test_equal_rows_share_what_is_taken(spark):
    rows = [(1, "a", "t " * 10)] * 1000 + [(2 + i, "b", "u " * 10) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for share in (0.5, 1.5):
        taken = sum(r.taken for r in mix(df, share=share).collect() if r.source == "a")
        got = repeated(df, share=share).where("source = 'a'").count() * 10
        assert got == taken > 0


def test_bins_are_even_whatever_the_weights(spark):
    from quarry.llm import mixing

    seen = {}
    real = mixing.prefix_sums

    def spy(df, group, bin_col, *rest):
        seen["largest"] = df.groupBy(*group, bin_col).count().agg(F.max("count")).first()[0]
        return real(df, group, bin_col, *rest)

    mixing.prefix_sums = spy
    try:
        rows = [(i, "a", "w " * 20 if i % 3 else "### " * 20) for i in range(20_000)]
        mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), bin_rows=500).count()
    finally:
        mixing.prefix_sums = real
    assert seen["largest"] < 700
