import datetime as dt
import os
import time

import pytest

from quarry.operators.indexing import Busy, Index, path_key, source_identity
from quarry.sources.files import changes, discover, discover_all, inventory
from tests.core.test_formats import docx, paragraph

TODAY = dt.date(2026, 9, 28)


def write(root, files):
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())


def sources(tmp_path, **more):
    return [{"id": "d", "kind": "design", "root": str(tmp_path / "d"), "extensions": [".md", ".docx"], **more}, {"id": "t", "kind": "table", "root": str(tmp_path / "t"), "extensions": [".csv"]}]


def test_what_is_never_indexed(spark, tmp_path):
    names = ["a.md", ".git/b.md", "x/Node_Modules/c.md", ".env.local.md", "deep/credentials.json", "deep/Service-Account-1.json", "config.local.md", "keep/draft-1.md", "old/z.md", "~$a.md", "ok.json"]
    write(tmp_path, {n: "text" for n in names})
    got = [r.relative_path for r in discover(spark, str(tmp_path), [".md", ".json"], exclude=("draft-?.md", "OLD")).collect()]
    assert sorted(got) == ["a.md", "ok.json"]


def test_sources_that_fail_hold_up_no_other(spark, tmp_path):
    write(tmp_path, {"d/a.md": "x"})
    files, issues = discover_all(spark, [*sources(tmp_path), {"id": "off", "kind": "design", "root": "/nowhere", "extensions": [".md"], "enabled": False}])
    assert [r.source_id for r in files.collect()] == ["d"] and [(i["source_id"], i["code"]) for i in issues] == [("t", "source_unavailable")]


def test_changes_of_listings(spark, tmp_path):
    write(tmp_path, {"d/a.md": "x", "d/b.md": "y", "t/c.csv": "a,b"})
    listing = lambda: spark.createDataFrame(discover_all(spark, sources(tmp_path))[0].drop("content").collect())
    before = listing()
    (tmp_path / "d/b.md").unlink()
    write(tmp_path, {"d/a.md": "longer", "d/n.md": "new"})
    after = listing()
    assert {(r.relative_path, r.change) for r in changes(before, after).collect()} == {("a.md", "changed"), ("b.md", "removed"), ("n.md", "added")}
    one, two = ({r.source_id: r.fingerprint for r in inventory(x).collect()} for x in (before, after))
    assert one["t"] == two["t"] and one["d"] != two["d"] and changes(after, after).count() == 0


def test_runs(spark, tmp_path):
    write(tmp_path, {"d/plan 2026-01-02.md": "# Top\n\nCafé 奖励 plan\n\n## Rules\nfirst\n\nsecond", "d/copy.md": "# Top\n\nCafé 奖励 plan\n\n## Rules\nfirst\n\nsecond", "d/doc.docx": docx(paragraph("one word")), "t/s.csv": "id,name\n1,pet", "d/bad.docx": b"no archive"})
    ix = Index(spark, str(tmp_path / "index"))
    assert ix.revision == 0 and ix.table("documents").count() == 0 and ix.status()["documents"] == 0
    run = ix.run(sources(tmp_path), TODAY)
    assert (run["discovered"], run["indexed"], run["failed"], run["unchanged"], run["phase"]) == (5, 4, 1, 0, "complete") and ix.revision == 1
    docs = {r.relative_path: r for r in ix.table("documents").collect()}
    a, b = docs["plan 2026-01-02.md"], docs["copy.md"]
    assert (str(a.effective_date.date()), a.date_source, a.family_key) == ("2026-01-02", "filename", "plan") and a.chunk_count == 3
    assert a.canonical_id == b.canonical_id in (a.doc_id, b.doc_id) and docs["doc.docx"].date_source == "embedded_modified"
    assert [(r.code, r.path.split("/")[-1]) for r in ix.recent("issues").collect()] == [("damaged_archive", "bad.docx")]
    terms = {(r.field, r.term) for r in ix.table("postings").where(f"doc_id = '{a.doc_id}'").collect()}
    assert {("body", "cafe"), ("body", "奖励"), ("heading", "rules"), ("title", "plan"), ("path", "plan")} <= terms
    rules = ix.table("postings").where(f"doc_id = '{a.doc_id}' AND field = 'heading' AND term = 'rules'").collect()
    assert [r.chunk_id[-2:] for r in rules] == ["_1"]
    sound = ix.consistency().first().asDict()
    assert sound["documents"] == 4 and not any(v for k, v in sound.items() if k not in ("documents", "chunks", "postings"))

    # nothing changed but the unreadable file: last good rows stay
    again = ix.run(sources(tmp_path), TODAY)
    assert (again["indexed"], again["unchanged"], again["failed"]) == (0, 4, 1)
    before = {r.chunk_id for r in ix.table("chunks").collect()}
    write(tmp_path, {"d/doc.docx": b"broken now", "d/copy.md": "# New\n\nother words"})
    (tmp_path / "t/s.csv").unlink()
    third = ix.run(sources(tmp_path), TODAY)
    assert (third["indexed"], third["failed"], third["deleted"]) == (1, 2, 1)
    docs = {r.relative_path: r for r in ix.table("documents").collect()}
    assert docs["doc.docx"].stale and docs["doc.docx"].extraction_error and docs["s.csv"].deleted and not docs["copy.md"].stale
    assert docs["copy.md"].canonical_id == docs["copy.md"].doc_id and {r.chunk_id for r in ix.table("chunks").where(f"doc_id = '{docs['doc.docx'].doc_id}'").collect()} <= before

    # a source that can't be listed loses nothing
    os.rename(tmp_path / "d", tmp_path / "away")
    fourth = ix.run(sources(tmp_path), TODAY)
    assert fourth["deleted"] == 0 and not {r.relative_path: r for r in ix.table("documents").collect()}["copy.md"].deleted
    assert ix.status()["stale"] == 1 and ix.recent("runs").count() == 4
    assert ix.invalidate(["t"]) == 0 and ix.invalidate(["d"]) == 3
    revision = ix.revision
    assert ix.purge(["d"])["documents"] == 3 and ix.revision == revision + 1 and ix.table("chunks").join(ix.table("documents"), "doc_id", "left_anti").count() == 0
    assert ix.clear() == revision + 2 and ix.table("documents").count() == 0 and ix.revision == revision + 2


def test_leases(spark, tmp_path):
    a, b = (Index(spark, str(tmp_path / "index")) for _ in range(2))
    a.acquire()
    a.acquire()
    with pytest.raises(Busy):
        b.acquire()
    b.acquire(time.time() + 60)
    with pytest.raises(Busy):
        a.acquire()
    a.release()
    with pytest.raises(Busy):
        a.acquire()
    b.release()
    a.acquire()


def test_identities():
    assert path_key("/a//b/../é") == "/a/é" and path_key("file:///a/./b") == "file:///a/b"
    assert source_identity("design", "/a/") == source_identity("design", "/a") != source_identity("table", "/a")
