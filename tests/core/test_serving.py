import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from quarry.engine import Config, Engine, Source, Vectors
from quarry.functions.query import understand
from quarry.operators import serving as V
from quarry.operators.indexing import Busy, Index, Overtaken
from tests.core.test_index import TODAY, sources, write

ROWS = "doc_id long, ordinal long, title string, heading string, path string, body string"


def rows(spark, texts):
    return spark.createDataFrame([(i, k, f"title {i}" if not k else None, None, f"p/{i}.md" if not k else None, t) for i, ts in texts.items() for k, t in enumerate(ts)], ROWS)


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, f"p/{i}.md", dt.date(2026, 1, 1 + i % 28)) for i in texts], "doc_id long, relative_path string, effective_date date")


def test_only_buckets_and_blocks_that_are_needed_are_read(spark, tmp_path):
    texts = {i: ["common words here", "common again"] + (["rare thing common"] if i % 50 == 0 else []) for i in range(300)}
    index = V.build(rows(spark, texts), str(tmp_path / "x"), buckets=32, block_chunks=20)
    read = index.table("postings", ["rare"])
    files = {r.f.split("/postings/")[1].split("/")[0] for r in read.select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    assert files == {f"bucket={V.bucket_of('rare', 32)}"} and read.inputFiles() and "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString()
    found, _ = index.weighted(understand("rare common"))
    got = index.concept_candidates(found, docs(spark, texts), 6, 2).collect()
    # six documents hold the rare word: the frequent one can't bring another in, and only their blocks are read for it
    assert index.read["choosing"] == 1 and len(index.read["blocks"][0]) <= 6
    everything = index.matches(["rare", "common"]).select("doc_id", "ordinal", index.score(found, ["rare", "common"]).alias("s")).collect()
    best = sorted(everything, key=lambda r: (-r.s, r.doc_id))
    assert {(r.doc_id, r.ordinal, -r.rank) for r in got} <= {(r.doc_id, r.ordinal, r.s) for r in best} and len(got) == 6 and all(r.doc_id % 50 == 0 for r in got)
    per = V.Postings(spark, index.parts).concept_candidates(found, docs(spark, texts), 400, 2)
    assert max(r["count"] for r in per.groupBy("doc_id").count().collect()) == 2


def test_copies_and_exact_rows_when_branches_meet(spark, tmp_path):
    d = docs(spark, range(4)).withColumn("canonical_id", F.when(F.col("doc_id") < 2, 0).otherwise(F.col("doc_id")))
    ranked = spark.createDataFrame([(0, 0, -1.0), (1, 0, -9.0), (2, 0, -2.0), (2, 0, -3.0), (3, 0, -3.0)], "doc_id long, ordinal long, rank double")
    exact = spark.createDataFrame([(1, 0, -5.0)], ranked.schema)
    assert [tuple(r) for r in V.merged(exact, [ranked], d).collect()] == [(1, 0, -9.0), (3, 0, -3.0), (2, 0, -3.0)]
    assert [r.doc_id for r in V.merged(None, [ranked], d, 2).collect()] == [1, 3]
    empty = V.build(rows(spark, {}), str(tmp_path / "e"))
    assert empty.weighted(understand("x word"))[0] == [] and empty.concept_candidates([], d, 5, 5).count() == 0 and empty.lexical_candidates(["word"], d, 5).count() == 0


def sums(ix):
    """Frequencies of all terms as the segments have them, and as the rows say."""
    at = ix.snapshot()
    p = at.serving("terms")
    stored = {}
    for _, path in p.parts:
        for r in ix.spark.read.parquet(f"{path}/terms").collect():
            stored[r.term] = stored.get(r.term, 0) + r.df
    live = {r.term: r["count"] for r in at.postings().select("chunk_id", "term").distinct().groupBy("term").count().collect()}
    return {k: v for k, v in stored.items() if v}, live, p.chunks, at.table("chunks").count()


def test_one_changed_file_is_one_segment(spark, tmp_path, monkeypatch):
    from quarry.operators import indexing

    write(tmp_path, {f"d/{i}.md": f"# Head {i}\n\nshared words {i}" for i in range(6)} | {"t/s.csv": "id,name\n1,pet"})
    ix = Index(spark, str(tmp_path / "index"))
    ix.run(sources(tmp_path), TODAY)
    reads = []
    work = indexing.processed
    monkeypatch.setattr(indexing, "processed", lambda files, *a, **k: reads.append(files.count()) or work(files, *a, **k))
    assert ix.run(sources(tmp_path), TODAY)["unchanged"] == 7 and reads == [] and ix.revision == 1
    write(tmp_path, {"d/3.md": "# Head 3\n\nother text entirely"})
    before = set(ix._names("segments"))
    run = ix.run(sources(tmp_path), TODAY)
    assert reads == [1] and (run["indexed"], run["unchanged"]) == (1, 6) and len(set(ix._names("segments")) - before) == 1
    stored, live, n, chunks = sums(ix)
    assert stored == live and n == chunks and "other" in live
    monkeypatch.setattr(Index, "MOST_SEGMENTS", 1)
    write(tmp_path, {"d/4.md": "# Head 4\n\nfourth now"})
    ix.run(sources(tmp_path), TODAY)
    stored, live, n, chunks = sums(ix)
    assert len(ix.snapshot().segments) == 2 and stored == live and n == chunks and {"fourth", "other"} <= set(live)


def test_takeover_and_crashes(spark, tmp_path):
    write(tmp_path, {"d/a.md": "one", "t/s.csv": "id\n1"})
    a, b = (Index(spark, str(tmp_path / "index")) for _ in range(2))
    a.run(sources(tmp_path), TODAY)
    # a begins, loses its lease to b, and b commits: a's work can't be committed
    a.acquire()
    base = a.snapshot()
    b.acquire(time.time() + 60)
    assert not a.holds() and not a.renew() and b.holds()
    assert b.commit({}, base.segments, b.snapshot()) == 2
    with pytest.raises(Overtaken):
        a.commit({}, base.segments, base)
    a.release()
    assert b.holds() and b.renew()
    b.release()
    # a pointer that was created and never written leaves the revision before, and the next writer goes on
    assert a.revision == 2 and len(a.table("documents").collect()) == 2
    top = tmp_path / "index" / "pointers"
    (top / "000000000003.json").write_bytes(b"")
    assert a.revision == 2 and a.table("documents").count() == 2
    reader = a.snapshot()
    write(tmp_path, {"d/b.md": "two"})
    assert a.run(sources(tmp_path), TODAY)["indexed"] == 1 and a.revision == 3
    assert reader.table("documents").count() == 2 and reader.table("chunks").count() == 2  # an older revision is still whole
    a.GRACE_SECONDS = 0
    write(tmp_path, {"d/c.md": "three"})
    a.run(sources(tmp_path), TODAY)
    assert len([n for n in os.listdir(top) if n.startswith("0") and a._load(f"pointers/{n}")]) == 1 and a.table("chunks").count() == 4
    with pytest.raises(Busy):
        b.acquire()
        a.acquire()


def test_copies_count_within_the_sources_that_are_asked_for(spark, tmp_path):
    write(tmp_path, {"a/same 2026-02-02.md": "# T\n\nunusual wording", "b/same 2026-01-01.md": "# T\n\nunusual wording", "b/other.md": "nothing"})
    own = (Source("a", "design", str(tmp_path / "a")), Source("b", "design", str(tmp_path / "b")))
    e = Engine(spark, str(tmp_path / "index"), Config(own), lambda: dt.date(2026, 9, 28))
    e.update()
    of = lambda **r: [h["title"] for h in e.search({"query": "unusual wording", **r})["hits"]]
    assert of() == ["same 2026-02-02"] and of(source_ids=["b"]) == ["same 2026-01-01"]
    e.config = Config((Source("a", "design", str(tmp_path / "a"), enabled=False), own[1]))
    assert of() == ["same 2026-01-01"]
    # substrings are found by the scan where the postings hold too few
    assert [h["title"] for h in e.search({"query": "nusual"})["hits"]] == ["same 2026-01-01"]
    ids = {r.title: r.chunk_id for r in e.index.table("chunks").join(e.index.table("documents"), "doc_id").select("title", "chunk_id").collect()}
    e.vectors = Vectors(spark.createDataFrame([(i, [1.0, 0.0] if t.startswith("other") else [0.0, 1.0]) for t, i in ids.items()], "chunk_id string, embedding array<double>"), lambda q: [0.0, 1.0])
    assert e.search({"query": "unusual", "mode": "hybrid"})["mode"] == "hybrid"


def test_terms_are_made_in_one_pass(spark):
    """Neither is a function called for each token nor are a chunk's terms grouped: that made a question's index of 0.1 GB take two minutes."""
    given = spark.createDataFrame([(1, 0, "Der Titel a/b_c", "Kopf", "x/y.md", "der Text. a/b_c, Café 奖励签到"), (1, 1, None, None, None, "mehr Text"), (2, 0, "nur", None, None, None)], ROWS)
    made = V.entries(given)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Exchange" not in plan and plan.count("Scan ") == 1
    got = {(r.doc_id, r.ordinal, r.term): (r.mask, r["size"]) for r in made.collect()}
    assert got[1, 0, "der"][0] == 9 and got[1, 0, "kopf"][0] == 2 and got[1, 0, "a/b_c"][0] == 9 and got[1, 0, "cafe"][0] == 8 and got[1, 0, "励签"][0] == 8
    assert got[1, 1, "mehr"] == (8, 2) and got[2, 0, "nur"] == (1, 1) and len(got) == made.count()
    assert {n for (d, o, _), (_, n) in got.items() if (d, o) == (1, 0)} == {4 + 1 + 3 + 9}
