import datetime

import pytest
from pyspark.sql import functions as F

from quarry.functions import query as Q
from quarry.operators import search as S

DAY = datetime.date(2026, 1, 1)
COLUMNS = "doc_id long, ordinal long, title string, heading string, relative_path string, source_kind string, family_key string, effective_date date, chunk_text string"


def chunk(doc, text, title="", path="", heading="", kind="design", ordinal=0, days=0):
    return (doc, ordinal, title, heading, path, kind, title or str(doc), DAY + datetime.timedelta(days), text)


@pytest.mark.parametrize("query, words", [("海灯鱼321 产出逻辑", ["海灯鱼321", "产出"]), ("dailyQuest coinPool 字段", ["dailyquest", "coinpool", "字段"]), ("id 的", []), ("", []), ("我想看看复用轮盘抽奖活动", ["复用", "轮盘", "抽奖", "活动"])])
def test_keywords(query, words):
    assert Q.keywords(query) == words


def test_plan():
    p = Q.understand("最新的 帮我北港777 POOL_001 配置表")
    assert p.latest and p.tables and p.named == (Q.Named("北港", "777"),) and "pool_001" in p.document_anchors
    assert abs(sum(c.weight for c in p.concepts) - 1) < 1e-12
    assert Q.understand("活动 12").named == () and Q.understand("").concepts == ()
    assert Q.ordered_terms(["12", "ab", "abc", "ab"]) == ["abc", "ab", "12"]


def test_named(spark):
    g = Q.Named("北港", "777")
    titles = {"北港777": (4.0, False), "北港·看灯人777": (2.375, False), "远北港·渔火777": (1.75, True), "北港 · 777": (4.0, False), "北港": (0.0, False)}
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = {r.t: (r.s, bool(r.e) and r.s > 0) for r in df.select("t", S.named_score(F.col("t"), g).alias("s"), S.embedded(F.col("t"), g).alias("e")).collect()}
    assert got == titles


def test_strength(spark):
    rows = [
        chunk(1, "", title="pet"), chunk(2, "", title="my pet"), chunk(3, "字段 | a=id | b=name 行 2 | a=1 | b=pet", kind="table"),
        chunk(4, "", path="pet/x.csv", kind="table"), chunk(5, "行 2 | a=1 | b=pet", kind="table"), chunk(6, "", path="a/pet.md"), chunk(7, "a pet"), chunk(8, "x"),
    ]
    got = spark.createDataFrame(rows, COLUMNS).select("doc_id", S.strength("pet").alias("s")).orderBy("doc_id").collect()
    assert [r.s for r in got] == [1.0, 0.85, 0.85, 0.8, 0.75, 0.65, 0.3, 0.0]


def test_search_prefers_rare_words_and_retrieve_keeps_to_its_budget(spark):
    rows = [chunk(i, "common word", title=f"note {i}", days=i) for i in range(1, 10)] + [chunk(50, "common rareword", title="rareword", ordinal=k) for k in range(5)]
    rows += [chunk(90 + i, "x" * 900 + " rareword common", title="sheet", kind="table") for i in range(4)] + [chunk(99, None, title=None)]
    chunks = spark.createDataFrame(rows, COLUMNS)
    plan = Q.understand("rareword common")
    found = S.search(chunks, plan, 5, "relevance").collect()
    assert found[0].doc_id == 50 and found[0].ordinals == [0, 1, 2]
    bundle = S.retrieve(chunks, plan, documents=4, per_document=2, characters=2000).orderBy("used").collect()
    assert bundle[-1].used <= 2000 and len({r.doc_id for r in bundle}) <= 4 and {r.doc_id for r in bundle} & {90, 91, 92, 93}
    assert S.search(chunks, Q.understand(""), 5).count() == 0 and S.search(chunks.limit(0), plan, 5).count() == 0


def test_ties_go_by_the_order_of_chinese(spark):
    rows = [chunk(i, "word", path=p) for i, p in enumerate(("重.md", "安.md", "b.md", "中.md", "A.md", "北.md"))]
    found = S.search(spark.createDataFrame(rows, COLUMNS), Q.understand("word"), 10, "relevance")
    assert [r.relative_path for r in found.collect()] == ["安.md", "北.md", "中.md", "重.md", "A.md", "b.md"]


def test_chunks_are_scored_once(spark):
    """What a search returns reads the scored documents from one written table; each use scored all chunks again before."""
    from quarry.plans import retrieval_queries as R
    from tests.conftest import SF

    got = R.search_hybrid(spark, SF)
    assert got.collect() and not any("documents.parquet" in f for f in got.inputFiles()) and got.inputFiles()
