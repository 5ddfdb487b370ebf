import datetime

from quarry.functions import query as Q
from quarry.operators import activities as A
from quarry.operators import search as S
from tests.core.test_search import COLUMNS, chunk

TITLES = {1: "北港·看灯人777活动", 2: "北港看灯人限时返场", 3: "远北港·渔火777活动", 4: "北港新活动", 5: "北港看灯人周年庆", 6: "夜市说明"}


def corpus(spark):
    texts = {1: "北港·看灯人777活动的玩法", 2: "北港看灯人777活动返场,改日期", 3: "远北港·渔火777活动的玩法", 4: "参考北港看灯人777活动", 5: "参考：北港看灯人777活动返场方案", 6: "北港777 顺带"}
    rows = [chunk(i, texts[i], title=TITLES[i], path=f"d/{i}.md", heading="概述", days=i) for i in TITLES]
    rows += [chunk(20 + i, f"字段 | a=北港777 | b={i}", title=f"表{i}", path=f"t/{i}.csv", kind="table", days=50 + i) for i in range(9)]
    return spark.createDataFrame(rows, COLUMNS)


def test_reruns_are_found_and_told(spark):
    chunks, plan = corpus(spark), Q.understand("复用北港777")
    docs = chunks.select("doc_id", "title", "relative_path", "effective_date").distinct()
    assert next(A.known_names(docs, plan.named[0])) == [("北港看灯人777", "北港看灯人", TITLES[1])]
    got = {r.doc_id: r for r in A.declared_reruns(chunks, plan).collect()}
    assert set(got) == {2, 5} and got[2].words and got[2].owner == TITLES[1] and got[5].words is None
    assert len(A.notes(A.declared_reruns(chunks, plan))) == 1 and TITLES[2] in A.notes(A.declared_reruns(chunks, plan))[0]
    warned = A.ambiguities(docs, plan)
    assert len(warned) == 1 and TITLES[1] in warned[0] and TITLES[3] in warned[0]
    assert A.declared_reruns(chunks, Q.understand("夜市")).count() == 0 and A.ambiguities(docs, Q.understand("夜市")) == []


def test_places_of_an_activity(spark):
    chunks, plan = corpus(spark), Q.understand("北港777")
    reruns = A.declared_reruns(chunks, plan)
    found = {r.doc_id for r in S.search(chunks, plan, 20).collect()}
    assert {1, 3} <= found and 6 not in found
    for n in (3, 4):
        got = {r.doc_id for r in S.retrieve(chunks, plan, documents=n, reruns=reruns).collect()}
        assert {1, 3} <= got and len(got) <= n
    tables = Q.understand("北港777 配表")
    got = {r.doc_id for r in S.retrieve(chunks, tables, documents=8).collect()}
    assert 1 in got and len(got & set(range(20, 29))) >= 5


def test_order_filters_and_chosen_documents(spark):
    rows = [chunk(i, f"alpha text {i}", title=f"alpha {i}", path=f"{i}.md", days=i % 7) for i in range(1, 30)] + [chunk(99, "alpha", title="alpha", days=0)]
    chunks, plan = spark.createDataFrame(rows, COLUMNS), Q.understand("alpha")
    newest = S.search(chunks, plan, 3, "newest").collect()
    assert all(r.effective_date == datetime.date(2026, 1, 7) for r in newest)
    assert S.search(chunks, plan, 1, "relevance").first().doc_id == 99
    assert S.search(chunks, plan, 3, "hybrid").count() == 3
    only = S.Filters(updated_after=datetime.date(2026, 1, 3), updated_before=datetime.date(2026, 1, 3))
    assert {r.effective_date for r in S.search(chunks, plan, 50, filters=only).collect()} == {datetime.date(2026, 1, 3)}
    assert {r.doc_id for r in S.retrieve(chunks, plan, chosen=(5, 6, 12345)).collect()} == {5, 6}
    required = Q.understand("alpha_9 alpha")
    rows.append(chunk(500, "alpha", title="alpha_9", path="old.md", days=-300))
    assert 500 in {r.doc_id for r in S.search(spark.createDataFrame(rows, COLUMNS), required, 1).collect()}


def test_targeted_chunks_cover_more_of_a_question(spark):
    rows = [chunk(1, t, title="plan", heading="alpha part", ordinal=k) for k, t in enumerate(["x", "y", "beta and gamma", "z", "beta"])]
    plan = Q.understand("alpha beta gamma")
    got = S.search(spark.createDataFrame(rows, COLUMNS), plan, 5, excerpts=2, targeted=True).first()
    assert 2 in got.ordinals and len(got.ordinals) == 2
