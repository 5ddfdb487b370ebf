from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans import registry
from tests.conftest import SF

TITLES = ["【复用】夜港活动 v1.2 2026-01-02", "奖励配置 说明文档", "plain title", "活动方案", "pool_001 version 3", "（旧版）轮盘_玩法"]


def test_every_document_is_answered(spark):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    for name in ("family_key_titles", "find_dates_texts"):
        assert sorted(r.doc_id for r in registry.queries()[name](spark, SF).collect()) == ids
    chunked = {r.doc_id for r in registry.queries()["chunk_lengths"](spark, SF).collect()}
    assert {r.doc_id for r in registry.queries()["doc_scores"](spark, SF).collect()} == chunked


def test_family_key_of_literals(spark):
    k = T.family_key(T.normalize_text(F.col("t")))
    got = spark.createDataFrame([(t,) for t in TITLES], "t string").select(k.alias("k")).select("k.key", "k.confidence").collect()
    assert len(got) == len(TITLES) and all(r.confidence is not None for r in got)


def test_every_twentieth_vector_is_a_query(spark):
    ids = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
    got = registry.queries()["semantic_neighbours"](spark, SF).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {i: min(80, len(ids)) for i in ids if i % 20 == 0}
