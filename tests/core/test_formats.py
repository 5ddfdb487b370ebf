import datetime as dt
import io
import zipfile

import pyarrow as pa
import pytest

from quarry.functions import dates as D
from quarry.functions.chunking import Block, chunks, coalesced, merged_locator, sheet_pieces
from quarry.plans import evidence_queries as E
from quarry.sources.formats import Unreadable, column_name, column_number, read

TODAY = dt.date(2026, 9, 28)
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def packed(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in entries.items():
            z.writestr(k.replace("__", "/").replace("_dot_", "."), v)
    return out.getvalue()


def docx(body, modified="2026-03-04T05:06:07Z"):
    return packed(word__document_dot_xml=f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>', docProps__core_dot_xml=f'<cp:x xmlns:cp="c" xmlns:d="d"><d:modified>{modified}</d:modified></cp:x>')


def paragraph(text, style=""):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


def xlsx(sheets, shared=(), macros=False):
    names = "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets))
    links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
    entries = {"xl/workbook.xml": f'<workbook xmlns:r="r">{names}</workbook>', "xl/_rels/workbook.xml.rels": f"<Relationships>{links}</Relationships>", "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>"}
    entries |= {f"xl/worksheets/s{i}.xml": f"<worksheet><sheetData>{x}</sheetData></worksheet>" for i, x in enumerate(sheets.values())}
    if macros:
        entries["xl/vbaProject.bin"] = b"x"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return out.getvalue()


def test_columns():
    assert [column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert [column_number(a) for a in ("A1", "z9", "AA3", "ZZ", "AAA7", "7")] == [0, 25, 26, 701, 702, 0]


def test_markdown_and_text():
    got = read("x", ".md", "# Top\n\na\r\nb\n\n### Deep\nc\n# Next\n".encode() + b"\n".join([b"line"] * 100), TODAY).blocks
    assert [(b.text.count("\n") + 1, b.headings, b.locator) for b in got] == [(2, ("Top",), "行 3-4"), (1, ("Top", "", "Deep"), "行 7"), (80, ("Next",), "行 9-88"), (20, ("Next",), "行 89-108")]
    assert read("x", ".yml", b"# no heading\nk: v", TODAY).blocks[0].headings == ()
    for bad in (b"", b" \n \n"):
        with pytest.raises(Unreadable):
            read("x", ".txt", bad, TODAY)
    assert read("x", ".txt", "奖励".encode("gb18030"), TODAY).warnings == ["encoding gb18030"]


def test_html():
    page = b"<h1>Title</h1><script>no()</script><p>one <b>two</b><p>three<ul><li>a<ul><li>b</li></ul></li><li>c</ul><table><tr><th>k<th>v<tr><td>1</td><td>2</td></table><p>2.1 Part</p><p>end."
    got = read("x", ".html", page, TODAY).blocks
    assert [(b.text, b.headings) for b in got] == [("one two", ("Title",)), ("three", ("Title",)), ("a b", ("Title",)), ("c", ("Title",)), ("k | v\n1 | 2", ("Title",)), ("end.", ("Title", "2.1 Part"))]


def test_csv():
    d = read("x", ".csv", "版本日期;name\n2026-01-02;x\n\n;y\n46000;z\n".encode(), TODAY)
    assert d.blocks[0].text == "字段 | A=版本日期 | B=name\n行 1 | A=版本日期 | B=name\n行 2 | A[版本日期]=2026-01-02 | B=x\n行 3 | B=y\n行 4 | A[版本日期]=46000 | B=z"
    assert d.blocks[0].locator == "CSV!A1:B4" and [(e.date.isoformat(), e.kind, e.locator) for e in d.evidence] == [("2026-01-02", "version_field", "CSV!A2")]
    many = read("x", ".csv", b"a,b\n" + b"1,2\n" * 60, TODAY).blocks
    assert [b.locator for b in many] == ["CSV!A1:B24", "CSV!A25:B48", "CSV!A49:B61"]


def test_docx():
    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{paragraph(x)}</w:tc>" for x in ("修改日期", "who")) + "</w:tr><w:tr>" + "".join(f"<w:tc>{paragraph(x)}</w:tc>" for x in ("2026-02-03", "me")) + "</w:tr></w:tbl>"
    d = read("x", ".docx", docx(paragraph("Top", "Heading1") + paragraph("one") + paragraph("two") + paragraph("") + paragraph("1.1 Part") + paragraph("long " * 1500) + paragraph("more " * 300) + table), TODAY)
    assert [(b.text[:8], b.headings, b.locator) for b in d.blocks] == [("one\ntwo", ("Top",), "段落 2-3"), ("long lon", ("Top", "1.1 Part"), "段落 6"), ("more mor", ("Top", "1.1 Part"), "段落 7"), ("修改日期 | w", ("Top", "1.1 Part"), "表格 1 行 1-2")]
    assert d.modified == dt.datetime(2026, 3, 4, 5, 6, 7, tzinfo=dt.UTC) and [e.date for e in d.evidence] == [dt.date(2026, 2, 3)]
    assert read("x", ".docx", docx(""), TODAY).needs_ocr
    for bad in (b"PK no archive", packed(a_dot_txt="x"), packed(word__document_dot_xml="<a><b>"), packed(word__document_dot_xml='<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')):
        with pytest.raises(Unreadable):
            read("x", ".docx", bad, TODAY)


def row(n, *cells):
    return f'<row r="{n}">' + "".join(cells) + "</row>"


def value(at, v, kind="", formula=""):
    return f'<c r="{at}" t="{kind}">{f"<f>{formula}</f>" if formula else ""}<v>{v}</v></c>'


def test_xlsx():
    sheet = row(1, value("B1", 0, "s"), value("A1", 1, "s")) + row(2, value("A2", 5), value("B2", 7, formula="A2+2")) + row(4, value("B4", "", formula="NOW()"))
    d = read("x", ".xlsm", xlsx({"Data": sheet}, ("name", "id"), macros=True), TODAY)
    assert d.blocks[0].text == "字段 | A=id | B=name\n行 1 | A=id | B=name\n行 2 | A=5 | B=7 {formula=A2+2}\n行 4 | B=[无缓存值] {formula=NOW()}"
    assert d.blocks[0].locator == "Data!A1:B4" and len(d.warnings) == 1
    axis = lambda *days: row(1, value("A1", "版本", "str"), *(value(f"{column_name(i + 1)}1", x) for i, x in enumerate(days))) + row(2, value("B2", 1), value("C2", 1))
    d = read("x", ".xlsx", xlsx({"one": axis(46100, 46200), "two": axis(46100, 46300)}), TODAY)
    assert {e.date for e in d.evidence} == {D.serial_date(46100, TODAY)}
    assert len(read("x", ".xls", xlsx({"Data": "".join(row(i, value(f"A{i}", i), value(f"B{i}", i)) for i in range(1, 400))}), TODAY).blocks) == 3
    for name, data in ((".xls", b"\xd0\xcf"), (".pdf", b"%PDF"), (".doc", b"x"), (".zip", b"x")):
        with pytest.raises(Unreadable) as e:
            read("x", name, data, TODAY)
        assert e.value.code == "unsupported_format"


def test_xmind():
    import json

    tree = {"title": "Plan", "rootTopic": {"title": "Root", "children": {"attached": [{"title": "A", "notes": {"plain": {"content": "note"}}}, {"title": " "}]}}}
    got = read("x", ".xmind", packed(content_dot_json=json.dumps([tree])), TODAY).blocks
    assert [(b.text, b.headings) for b in got] == [("Root", ("Root",)), ("A\nnote", ("Root", "A")), ("未命名主题", ("Root", "未命名主题"))]
    assert [b.text for b in read("x", ".xmind", packed(content_dot_xml="<x><title>One</title><y><title>Two</title></y></x>"), TODAY).blocks] == ["One", "Two"]


def test_sheet_chunks():
    lines = ["字段 | A=id | B=text"] + [f"行 {n} | A={n} | B={'x' * 60}" for n in range(3, 500)]
    b = Block("\n".join(lines), ("Data",), "", "Data!A3:B499")
    got = chunks([b, Block(" \n"), Block("plain")])
    assert [c.text.split("\n")[0] for c in got[:-1]] == [lines[0]] * (len(got) - 1) and all(len(c.text) <= 16_000 for c in got)
    assert [x for c in got[:-1] for x in c.text.split("\n")[1:]] == lines[1:]
    ends = [(int(c.locator.split("!A")[1].split(":")[0]), int(c.locator.split(":B")[1])) for c in got[:-1]]
    assert ends[0][0] == 3 and ends[-1][1] == 499 and all(a[1] + 1 == z[0] for a, z in zip(ends, ends[1:], strict=False))
    assert sheet_pieces("no sheet", "x") == [] and merged_locator("S!A1:B2", "S!A3:B4") == "S!A1:B4" and merged_locator("S!A1:B2", "T!A3:B4") is None
    assert [c.text for c in coalesced([Block("abc def", (), "x", "p"), Block("def ghi", (), "x", "p"), Block("other", ("h",), "x", "p")])] == ["abc def ghi", "other"]


def test_dates_of_logs():
    log = lambda text, *heads: Block(text, heads, "version_history", "")
    assert D.log_dates("design", [log("版本日期 | who\n46000 | x\n[修改日期]=46001")], TODAY)[0] == D.serial_date(46001, TODAY)
    assert D.log_dates("design", [log("版本 2026-01-02 更新\n2026-05-05 plain")], TODAY) == (dt.date(2026, 1, 2), None)
    assert D.log_dates("design", [log("版本 20269902 then 2026-05-05")], TODAY) == (None, None)
    assert D.log_dates("design", [log("版本: v1.2 2026-03-03")], TODAY) == (None, dt.date(2026, 3, 3))
    assert D.log_dates("table", [log("更新 2026-01-02", "Sheet")], TODAY) == (None, None) and D.log_dates("table", [log("更新 2026-01-02", "修改记录")], TODAY)[0]
    assert D.short_year_dates("3/4/26 13/1/26 1/2/2026", TODAY) == {dt.date(2026, 3, 4)}
    assert D.serial_dates("43887 46414 71275 123456", TODAY) == {dt.date(2020, 2, 26), dt.date(2027, 1, 27)}


def test_priority_of_dates():
    at = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
    strong, weak = D.Evidence(dt.date(2026, 2, 2), "k", "l"), D.Evidence(dt.date(2026, 3, 3), "k", "l", "weak")
    of = lambda stem="x", path="p", evidence=None, embedded=None: D.resolve(stem, path, "design", [], evidence, embedded, at, TODAY)
    assert of("plan 2026-04-04", "2026-05-05", [strong])[1] == "filename" and of("x", "2026-05-05", [strong, weak]) == (dt.datetime(2026, 2, 2, tzinfo=dt.UTC), "version_log")
    assert of("x", "a/2026-05", [weak])[1] == "path" and of("x", "p", [weak])[1] == "version_log" and of("x", "p", [], at.replace(month=6))[1] == "embedded_modified"
    assert of("x", "p", [], at.replace(year=1999)) == (at, "filesystem_mtime") and not D.reads_embedded("v 20260101", "p", TODAY)


def test_dates_from_outside():
    assert D.search_date("2026-01-02") == dt.datetime(2026, 1, 2, tzinfo=dt.UTC) and D.search_date("2026-01-02T03:04:05.123456789+02:00").hour == 1
    for bad in ("2026-1-2", "2026-01-02T03:04:05", "x", "2026-02-30"):
        with pytest.raises(ValueError):
            D.search_date(bad)
    assert D.pdf_date("D:20260102030405+02'00'") == dt.datetime(2026, 1, 2, 1, 4, 5, tzinfo=dt.UTC) and D.pdf_date("D:20260231") is None and D.pdf_date("D:20260102") == dt.datetime(2026, 1, 2, tzinfo=dt.UTC)


def test_pages_are_cut_a_few_at_a_time(spark, tmp_path):
    """A whole batch's blocks as Python values took gigabytes; what leaves for Spark is a few pages at a time."""
    pages = [(i, None if i == 7 else f"<h2>第{i}章 玩法</h2><p>one {i}</p><p>two</p>") for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in pages]), pa.array([h for _, h in pages])], names=["page_id", "html"])
    parts = list(E.cut_pages(iter([batch])))
    assert len(parts) > 1 and max(len(set(p.column(0).to_pylist())) for p in parts) <= E.PAGES
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = E.html_blocks(spark, str(tmp_path))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    want = [(i, k, b.text, " / ".join(b.headings), b.section, b.locator) for i, h in pages for k, b in enumerate(E.blocks_of_html(h or ""))]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) >= 598
