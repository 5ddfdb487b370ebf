import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import fold
from quarry.operators import citations as C

FACES = "a🙂b 奖励é"


def test_units():
    assert C.length16(FACES) == 8 and C.slice16(FACES, 0, 2) == "a" and C.slice16(FACES, 2, 5) == "b " and C.slice16(FACES, 1, 3) == "🙂"
    assert C.find16("xx🙂Pet pet", "PET") == 4 and C.find16("abc", "") == -1 and C.find16("abc", "z") == -1
    for bad in ((-1, 2), (3, 2), (0, 99)):
        with pytest.raises(C.BadCitation):
            C.slice16(FACES, *bad)


def test_around():
    text = "x" * 1000 + " needle " + "🙂" * 600
    for limit in (1, 2, 5, 60, 520, 2207, 2208, 3000):
        out, part = C.around(text, ["absent", "needle"], limit)
        assert C.length16(out) <= limit and (limit >= C.length16(text)) == (out == text)
        assert limit < 20 or "needle" in out
        assert limit < 20 or C.slice16(text, *part).strip() in out
    assert C.around(text, ["absent"], 10) == ("x" * 9 + "…", (0, 9))


def sheet(rows=192, columns=4, wide=8):
    names = [chr(65 + k) for k in range(columns)]
    head = "字段 | " + " | ".join(f"{c}=field {c}" for c in names)
    return "\n".join([head, *(f"行 {n} | " + " | ".join(f"{c}={'v' * wide}{n}{c}" for c in names) for n in range(1, rows + 1))]), f"Data!A1:{names[-1]}{rows}"


def test_sheets():
    text, at = sheet()
    e = C.excerpt(text, at, ["v150b"])
    assert C.length16(e.text) <= 520 and re.fullmatch(r"Data!A148:[CD]152", e.locator) and e.text.split("\n")[0].startswith("字段映射（投影） | A=field A")
    assert C.replay(text, at, e.scope) == e.text
    wide = C.excerpt(text, at, ["v150b"], 2400)
    assert 520 < C.length16(wide.text) <= 2400 and C.replay(text, at, wide.scope) == wide.text and set(e.text.split("\n")[1:]) <= set(wide.text.split("\n"))
    text, at = sheet(30, 20, 300)
    e = C.excerpt(text, at, ["v9k"])
    assert e.locator.endswith("9") and C.length16(e.text) <= 520 and e.scope.row_slice and C.replay(text, at, e.scope) == e.text and len(e.scope.columns) <= 12
    assert C.excerpt("no sheet", at, ["x"]).scope is None and C.excerpt(text, "no range", ["x"]).scope is None


CHUNK = "chunk_00112233445566aa_8899aabb_7"


def test_identifiers_come_back_and_notice_damage():
    rnd = random.Random(1)
    cases = [sheet(), sheet(30, 20, 300), sheet(5, 2), ("plain words " * 200, "行 1"), ("short", "行 1"), ("🙂 face " * 300, "段落 3")]
    for text, at in cases:
        for term in ("v3b", "plain", "face", "none"):
            chunk = {"text": text, "locator": at, "content_hash": C.digest("x", text, b"")}
            e = C.excerpt(text, at, [term])
            for chunk_id in (CHUNK, "other-id"):
                if chunk_id != CHUNK and e.slice:
                    with pytest.raises(C.BadCitation):
                        C.identifier(chunk_id, at, chunk["content_hash"], e)
                    continue
                cite = C.identifier(chunk_id, at, chunk["content_hash"], e)
                ref = C.parse(cite)
                assert ref.chunk_id == chunk_id
                back = C.recall(ref, chunk, cite)
                assert back.text == e.text and back.locator == e.locator
                if ref.kind == "chunk":
                    continue
                with pytest.raises(C.BadCitation):
                    C.recall(ref, chunk | {"content_hash": "changed"}, cite)
                for _ in range(30):  # one character differs
                    k = rnd.randrange(len("cite:2."), len(cite))
                    bad = cite[:k] + rnd.choice("ABCxyz019_-") + cite[k + 1 :]
                    if bad == cite:
                        continue
                    try:
                        r = C.parse(bad)
                    except C.BadCitation:
                        continue
                    if r.chunk_id == chunk_id and r.kind != "chunk":
                        with pytest.raises(C.BadCitation):
                            C.recall(r, chunk, bad)
    for bad in ("cite:2.AA.x", "cite:3..", "cite:x~y", "cite:x~AAAA.z", "cite:3.____________________.abc"):
        with pytest.raises(C.BadCitation):
            C.parse(bad)
    assert C.parse("cite:anything") == C.Reference("anything")


def test_numbers():
    for values in ([], [0, 127, 128, 300, C.MOST_INT], list(range(1000))):
        assert C.read_varints(C.varints(values)) == values
    for bad in (b"\x80", b"\xff" * 6, b"\xff\xff\xff\xff\x7f"):
        with pytest.raises(C.BadCitation):
            C.read_varints(bad)


def test_links_and_marks():
    link = C.source_link("C:\\a\\[x]>.md", "行 `1`")
    assert link["markdown"] == "[\\[x\\]>.md](<C:/a/[x]%3E.md>) · `行 '1'`" and link["label"] == "[x]>.md · 行 `1`"
    assert C.highlighted("Pet and petal", ["pet", "and", " "]) == "**Pet** **and** **pet**al"


def test_columns_and_reading(spark):
    text, at = sheet()
    docs = spark.createDataFrame([("d1", "Title", "/p/x.csv", "x.csv", "s", "table", False, False), ("d2", "Gone", "/p/y.md", "y.md", "s", "design", False, True)], "doc_id string, title string, path string, relative_path string, source_id string, source_kind string, stale boolean, deleted boolean")
    chunks = spark.createDataFrame([("d1", CHUNK, ["h"], "config", at, text, "hash"), ("d2", "chunk_gone", [], "other", "行 1", "x", "hash")], "doc_id string, chunk_id string, headings array<string>, section string, locator string, text string, content_hash string")
    got = chunks.where("doc_id = 'd1'").select(C.excerpts(F.col("text"), F.col("locator"), F.col("chunk_id"), F.col("content_hash"), [fold("V150B")]).alias("e")).first().e
    assert "**v" not in got.text and "**" in got.highlighted
    back = C.read_citation(docs, chunks, got.citation, 5, expected=4, sources=["s"])
    assert back["content"] == got.text and back["changed"] and back["display"].startswith("Title · h · Data!A148") and back["citation"] == got.citation
    for cite, sources in ((got.citation, ["other"]), ("cite:chunk_gone", None), ("cite:unknown", None)):
        with pytest.raises(LookupError):
            C.read_citation(docs, chunks, cite, 5, sources=sources)
