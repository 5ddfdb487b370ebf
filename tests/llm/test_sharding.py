import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quarry.llm.sharding import balanced, cut_edges, op4_balanced_shards
from tests.conftest import SF


def check(rows, texts, n_shards=40):
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    by_id = defaultdict(set)
    for i, t in texts:
        by_id[i].add(t)
    for r in rows:
        assert (r["size"], r.text_crc32) in {(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in by_id[r.doc_id]}
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < n_shards
    n = Counter(r.shard for r in rows)
    counts = [n[s] for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(n_shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def spread(rows):
    g = defaultdict(list)
    for r in rows:
        g[r.gid if "gid" in r else r.group_key].append(r.shard)
    return g


def test_documents(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = op4_balanced_shards(spark, SF).collect()
    check(rows, texts)
    key = lambda x: sorted((r.doc_id, r.shard, r.slot) for r in x)
    assert key(rows) == key(op4_balanced_shards(spark, SF).collect())


def test_groups_gather(spark):
    texts = [(i, f"alone {i}") for i in range(600)] + [(1000 + i, f"group {i // 5}") for i in range(200)] + [(2000 + i, "hot") for i in range(400)] + [(5000 + i, None) for i in range(3)] + [(5100, ""), (5101, "é" * 9000), (5101, "é" * 9000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    rows = balanced(df, n_shards=10, bin_rows=50).collect()
    check(rows, texts, 10)
    g = spread(rows)
    whole = [v for v in g.values() if len(v) == 5]
    assert sum(len(set(v)) == 1 for v in whole) >= 0.9 * len(whole)
    hot = Counter(next(v for v in g.values() if len(v) == 400))
    assert max(hot.values()) >= 100  # a shard is filled with it
    assert balanced(df.limit(0), n_shards=10).count() == 0
    check(balanced(df.limit(3), n_shards=10).collect(), [(r.doc_id, r.text) for r in df.limit(3).collect()], 10)


def test_a_hot_group_fills_one_shard_after_the_other(spark):
    texts = [(i, f"alone {i}") for i in range(500)] + [(1000 + i, f"group {i // 5}") for i in range(300)] + [(2000 + i, "hot") for i in range(400)]
    out = balanced(spark.createDataFrame(texts, "doc_id long, text string"), n_shards=20, bin_rows=50)
    rows = out.collect()
    check(rows, texts, 20)
    hot = Counter(next(v for v in spread(rows).values() if len(v) == 400))
    assert len(hot) <= 8  # 400 rows, 60 a shard: 7 at least
    pairs = lambda c: sum(n * (n - 1) // 2 for n in c)
    groups = spread(rows).values()
    edges = cut_edges(out).first()
    assert edges.edges == pairs(map(len, groups)) and edges.cut == edges.edges - sum(pairs(Counter(v).values()) for v in groups)


def test_propagation_cuts_fewer_links_even_where_no_place_is_free(spark):
    """Every document has a copy here, so that linked documents alone fill the shards: the hardest case."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100_000))
    before, after = (cut_edges(balanced(docs, rounds=r)).first() for r in (0, None))
    assert before.edges == after.edges and after.cut < before.cut
