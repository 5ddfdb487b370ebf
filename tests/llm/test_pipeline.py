import corpus_pipeline
from quarry.llm.mixing import mix
from tests.conftest import SF
from tests.llm.test_decontaminate import brute_tiles, words
from tests.llm.test_near_dup import brute as components
from tests.llm.test_quality import brute as quality
from tests.llm.test_tokens import brute_rows


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
            assert all(r == before[r.doc_id] for r in rows)
        ids = sorted(r.doc_id for r in rows)
        if k == 0:
            assert ids and all(not quality(before[i].text)["base_failed"] for i in ids)
            assert len(ids) >= 0.9 * sum(not quality(r.text)["base_failed"] for r in before.values()) - 20
        elif k == 1:
            assert ids == sorted(i for i, (_, c) in components({i: r.text for i, r in before.items()}, 5).items() if i == c)
        elif k == 2:
            gone = set(before) - set(ids)
            for i in gone:
                w = words(before[i].text)
                assert len(w) > 3000 or any(brute_tiles(w, x) >= 0.5 * len(x) for x in items if set(zip(x, x[1:], strict=False)) & set(zip(w, w[1:], strict=False)))
        elif k == 3:
            taken = {r.doc_id: r.taken // max(r["size"], 1) for r in mix(spark.createDataFrame(list(before.values()), out.schema)).collect()}
            assert ids == sorted(i for i, n in taken.items() for _ in range(n))
            mixed = sorted(((r.doc_id, r.text) for r in rows), key=lambda x: x[0])
        else:
            assert sorted(map(tuple, rows)) == brute_rows(mixed)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and rows[0].asDict().keys() == {"doc_id", "start", "n_tokens", "ids_crc32"}
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_stages_of_empty_and_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "a", 0), (None, None, None, "a", None)], docs.schema)
    for k, (rows, last) in enumerate(((docs.limit(0), 0), (odd, 0))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            path = str(tmp_path / f"{k}-{name}")
            out.write.parquet(path)
            rows = spark.read.schema(out.schema).parquet(path)
        assert rows.count() == last
