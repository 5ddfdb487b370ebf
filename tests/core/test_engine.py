import datetime as dt
import json

import pytest

from quarry.engine import BadRequest, Config, Engine, Job, Request, Source, checked, rounded, short_date, with_sources
from quarry.streaming.watch import Progress, retried, scan, watch
from tests.core.test_index import write


def engine(spark, tmp_path):
    write(tmp_path, {
        "plans/北港·看灯人777活动_20251119.md": "# 玩法\n\n北港·看灯人777活动的玩法与奖励。", "plans/北港看灯人限时返场_20260603.md": "# 概述\n\n北港看灯人777活动返场,改日期。",
        "plans/notes 2026-01-01.md": "# Notes\n\nPOOL_001 is described here.\n\n" + "long text " * 200, "sheets/pool.csv": "id,name\n1,POOL_001\n2,other", "plans/notes 2026-02-02.md": "# Notes\n\nnewer words",
    })
    sources = (Source("p", "design", str(tmp_path / "plans")), Source("t", "table", str(tmp_path / "sheets")))
    return Engine(spark, str(tmp_path / "index"), Config(sources), lambda: dt.date(2026, 9, 28))


def test_answers(spark, tmp_path):
    e = engine(spark, tmp_path)
    assert e.update()["indexed"] == 5
    found = e.search({"query": "POOL_001", "sort": "relevance"})
    assert {h["title"] for h in found["hits"]} == {"pool", "notes 2026-01-01"}
    found = e.search({"query": "POOL_001", "source_kinds": ["design"]})
    assert [(h["title"], h["date"]) for h in found["hits"]] == [("notes 2026-01-01", "2026-01-01")]
    cite = found["hits"][0]["excerpts"][0]["citation"]
    back = e.read_citation(cite, found["revision"])
    assert "POOL_001" in back["content"] and not back["changed"]
    named = e.retrieve({"query": "北港777", "documents": 2})
    assert [d["title"] for d in named["documents"]] == ["北港看灯人限时返场_20260603", "北港·看灯人777活动_20251119"] and any("返场" in w for w in named["warnings"])
    ids = [d["doc_id"] for d in named["documents"]]
    only = e.retrieve({"query": "奖励", "document_ids": [ids[1], "doc_unknown"]})
    assert [d["doc_id"] for d in only["documents"]] == [ids[1]] and "doc_unknown" in only["warnings"][0]
    assert e.search({"query": "words", "source_ids": ["nowhere"]})["warnings"] and e.search({"query": ""})["hits"] == []
    assert [v["date"] for v in e.versions(family_key="notes")] == ["2026-02-02", "2026-01-01"] and e.versions(document_id="doc_none") == []
    change = e.reconfigure(with_sources(e.config, t=None))
    assert change == {"p": "same", "t": "removed"} and "t" not in e.status()["sources"]


def test_jobs_and_streams(spark, tmp_path):
    e = engine(spark, tmp_path)
    job = Job(e)
    job.pause()
    job.start()
    assert job.wait(0.3) in ("paused", "running") and not job.progress
    job.resume()
    assert job.wait(300) == "complete" and [p["indexed"] for p in job.progress] == [4, 1]
    heard = []
    write(tmp_path, {"plans/new.md": "fresh text"})
    q = watch(spark, e, once=True, told=heard.append)
    assert q.awaitTermination(300) and sum(r["indexed"] for r in heard) == 1
    (tmp_path / "plans/new.md").unlink()
    assert scan(e)["deleted"] == 1
    told = []
    Progress(told.append).onQueryTerminated(type("E", (), {"exception": None}))
    assert told == [{"event": "terminated", "failed": False}]


def test_waiting_for_a_lease():
    from quarry.operators.indexing import Busy

    left = [Busy("x"), Busy("x"), {"ok": 1}]

    def work():
        x = left.pop(0)
        if isinstance(x, Busy):
            raise x
        return x

    assert retried(work, wait=0.001) == {"ok": 1}
    with pytest.raises(Busy):
        retried(lambda: (_ for _ in ()).throw(Busy("x")), attempts=2, wait=0.001)


def test_configurations():
    c = Config((Source("a", "design", "/x", extensions=(".MD",)), Source("b", "table", "/y")))
    assert Config.load(c.dump()) == c and c.fingerprint == Config.load(json.dumps(json.loads(c.dump()))).fingerprint and c.sources[0].extensions == (".md",)
    for bad in ('{"x": 1}', "[]", "{", '{"sources": [{"id": "a", "kind": "design", "root": "rel"}]}', '{"limit": 0}', '{"sources": [{"id": "a", "kind": "design", "root": "/x"}, {"id": "b", "kind": "table", "root": "/x/y"}]}', '{"sort": "x"}', '{"sources": 3}'):
        with pytest.raises(BadRequest):
            Config.load(bad)
    for bad in ({"query": "x", "unknown": 1}, {}, {"query": "x", "limit": 101}, {"query": "x", "updated_after": "soon"}, {"query": "x", "source_kinds": ["x"]}, {"query": "x", "mode": "x"}):
        with pytest.raises(BadRequest):
            checked(Request, bad)
    assert short_date(dt.datetime(2026, 1, 2)) == "2026-01-02" and short_date(dt.datetime(2026, 1, 2, 3, 4, 5, 6)) == "2026-01-02T03:04:05Z" and rounded(0.125) == 0.13
