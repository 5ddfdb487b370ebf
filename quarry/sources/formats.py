"""Documents of every format as blocks with headings and places, from their bytes alone.

Nothing is evaluated or fetched. What can't be read raises Unreadable with the code of its issue.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

from quarry.functions.chunking import FIELDS_MARK, ROW_MARK, Block
from quarry.functions.dates import _DATE_HEADER, Evidence, SheetDates, block_evidence, core_modified, reconcile_sheets
from quarry.functions.text import section_of
from quarry.sources.files import decode_named, delimiter

# Bytes of an archive's entry, lines of a block, characters of a run of paragraphs, rows of a group.
MOST_ENTRY, BLOCK_LINES, PARAGRAPHS, CSV_ROWS, SHEET_ROWS, PROPERTY_ROWS = 768 << 20, 80, 7_200, 24, 192, 144
# Words of places, and names for what has none.
LINE, PARAGRAPH, TABLE, NO_VALUE, NO_TOPIC, NO_SHEET = "行", "段落", "表格", "[无缓存值]", "未命名主题", "工作表"
# What looks like a heading.
NUMBERED = r"第[一二三四五六七八九十百0-9]+[章节部分]|[一二三四五六七八九十]+[、.]|[0-9]+(?:\.[0-9]+){0,3}[、.\s]|【[^】]+】"
TOPICS = "概述|版本|修订|流程|玩法|规则|面板|逻辑|配置|配表|奖励|数值|统计|美术|原画|动画|需求"
SENTENCE_END = "。！？!?；;"
VERSION_WORDS = {"版本", "修订", "修改", "更新", "变更", "version", "revision"}
csv.field_size_limit(1 << 30)
_NUMBERED, _TOPIC = re.compile(f"^(?:{NUMBERED})"), re.compile(f"(?:{TOPICS})$")
_MD_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")


class Unreadable(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Document:
    title: str
    blocks: list[Block]
    warnings: list[str] = field(default_factory=list)
    #: None where only the version log's lines speak of dates.
    evidence: list[Evidence] | None = None
    modified: dt.datetime | None = None
    needs_ocr: bool = False


class Headings:
    """The headings above the current place."""

    def __init__(self) -> None:
        self.path: tuple[str, ...] = ()

    def enter(self, level: int, text: str) -> None:
        self.path = (*self.path[: level - 1], *[""] * (level - 1 - len(self.path)), text)


def block(text: str, headings: tuple[str, ...], locator: str) -> Block:
    return Block(text, headings, section_of(headings, text), locator)


def span(word: str, first: int, last: int) -> str:
    return f"{word} {first}-{last}" if last > first else f"{word} {first}"


def line_blocks(text: str, markdown: bool = False, word: str = LINE) -> list[Block]:
    """Lines between blank ones, at most BLOCK_LINES of them; in Markdown below their headings."""
    out: list[Block] = []
    above, run, first = Headings(), [], 1

    def flush() -> None:
        if content := "\n".join(run).strip():
            out.append(block(content, above.path, span(word, first, first + len(run) - 1)))
        run.clear()

    for n, line in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        heading = _MD_HEADING.match(line) if markdown else None
        if heading or not line.strip():
            flush()
            if heading:
                above.enter(len(heading[1]), heading[2].strip())
            continue
        if not run:
            first = n
        run.append(line)
        if len(run) >= BLOCK_LINES:
            flush()
    flush()
    return out


def heading_level(text: str, topics: bool) -> int:
    """Level of a line that looks like a heading; 0 if it doesn't."""
    if not 2 <= len(text) <= 80 or text[-1] in SENTENCE_END or not (_NUMBERED.match(text) or (topics and _TOPIC.search(text))):
        return 0
    return min(6, text.count(".") + 1)


class _Html(HTMLParser):
    """Paragraphs, items, headings and tables of a page, in order; markup inside them goes."""

    SKIP = {"script", "style", "noscript"}
    HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
    LEAVES = {"p", "li"} | HEADS
    LISTS = {"ul", "ol"}
    #: What ends an open paragraph.
    ENDS_P = LEAVES | LISTS | {"table", "div", "section", "article", "aside", "header", "footer", "main", "nav", "blockquote", "pre", "form", "hr", "dl", "figure"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, list]] = []
        self.skip = self.leaf = ""
        #: Lists open inside of the current item: their items are part of it.
        self.lists = 0
        self.texts: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if self.skip:
            return
        if tag in self.SKIP:
            self.skip = tag
            return
        if (self.leaf == "p" and tag in self.ENDS_P) or (self.leaf in self.HEADS and tag in self.HEADS) or (self.leaf == tag == "li" and not self.lists):
            self.end_leaf()
        if self.leaf:
            self.lists += self.leaf == "li" and tag in self.LISTS
        elif tag == "table":
            self.tables.append([])
        elif len(self.tables) == 1 and tag in ("tr", "td", "th"):
            self.end_cell()
            if tag == "tr":
                self.tables[0].append([])
            else:
                self.cell = []
        elif not self.tables and tag in self.LEAVES:
            self.leaf = tag

    def handle_endtag(self, tag):
        if self.skip:
            self.skip = "" if tag == self.skip else self.skip
        elif self.leaf == "li" and self.lists:
            self.lists -= tag in self.LISTS
        elif self.leaf:
            if tag == self.leaf or tag in ("body", "html") or (self.leaf == "li" and tag in self.LISTS) or (self.leaf == "p" and tag in self.ENDS_P):
                self.end_leaf()
        elif tag == "table" and self.tables:
            if len(self.tables) == 1:
                self.end_cell()
                self.out.append(("table", self.tables[0]))
            self.tables.pop()
        elif len(self.tables) == 1 and tag in ("td", "th", "tr"):
            self.end_cell()

    def handle_data(self, data):
        t = " ".join(data.split())
        if not t or self.skip:
            return
        if self.leaf:
            self.texts.append(t)
        elif self.cell is not None:
            self.cell.append(t)

    def end_cell(self):
        if self.cell is not None:
            if not self.tables[0]:
                self.tables[0].append([])
            self.tables[0][-1].append(" ".join(self.cell))
        self.cell = None

    def end_leaf(self):
        if self.texts:
            self.out.append((self.leaf, [" ".join(self.texts)]))
        self.leaf, self.texts, self.lists = "", [], 0

    def close(self):
        super().close()
        self.end_leaf()
        while self.tables:
            self.handle_endtag("table")


def html_blocks(text: str) -> list[Block]:
    """Paragraphs, items and tables below headings, by tag or by look; text outside of them isn't evidence."""
    page = _Html()
    page.feed(text)
    page.close()
    out, above, paragraphs, tables = [], Headings(), 0, 0
    for tag, content in page.out:
        if tag == "table":
            tables += 1
            rows = [" | ".join(r) for r in content if any(r)]
            if rows:
                out.append(block("\n".join(rows), above.path, f"{TABLE} {tables} {ROW_MARK} 1-{len(rows)}"))
            continue
        paragraphs += 1
        level = int(tag[1]) if tag[0] == "h" else heading_level(content[0], topics=True)
        if level:
            above.enter(level, content[0])
        else:
            out.append(block(content[0], above.path, f"HTML {PARAGRAPH} {paragraphs}"))
    return out


def column_name(column: int) -> str:
    """Letters of a column counted from 0."""
    name = ""
    column += 1
    while column > 0:
        column, r = divmod(column - 1, 26)
        name = chr(65 + r) + name
    return name


def column_number(address: str) -> int:
    """Column, from 0, of a cell's address; 0 without letters."""
    n = 0
    for c in address.upper():
        if not "A" <= c <= "Z":
            break
        n = n * 26 + ord(c) - 64
    return max(0, n - 1)


@dataclass
class Cell:
    column: int
    address: str
    text: str
    raw: str = ""
    cached: str = ""
    formula: str = ""


def sheet_block(sheet: str, rows: list[tuple[int, list[Cell]]], fields: dict[int, str]) -> Block | None:
    """Rows of a sheet as text: a line of fields, then a line a row; None without cells."""

    def shown(c: Cell) -> str:
        name = fields.get(c.column, "")
        keep = name and name != c.text and (name.strip().lower() in VERSION_WORDS or _DATE_HEADER.search(name.strip().lower()))
        extra = "; ".join(x for x in (f"raw={c.raw}" if c.raw and c.raw != c.cached else "", f"formula={c.formula}" if c.formula else "") if x)
        return f"{column_name(c.column)}{f'[{name}]' if keep else ''}={c.text or NO_VALUE}{f' {{{extra}}}' if extra else ''}"

    full = [(n, [c for c in cells if c.text or c.formula]) for n, cells in rows]
    columns = [c.column for _, cells in full for c in cells]
    if not columns:
        return None
    lines = [" | ".join([FIELDS_MARK, *(f"{column_name(k)}={fields[k]}" for k in sorted(fields))])] if fields else []
    lines += [" | ".join([f"{ROW_MARK} {n}", *map(shown, cells)]) for n, cells in full if cells]
    return block("\n".join(lines), (sheet,), f"{sheet}!{column_name(min(columns))}{rows[0][0]}:{column_name(max(columns))}{rows[-1][0]}")


def sheet_blocks(sheet: str, rows: Iterator[tuple[int, list[Cell]]], group: int, longest_field: int | None, today: dt.date) -> tuple[list[Block], list[Evidence]]:
    """Blocks of so many rows, and the dates; the first row of two cells or more names the fields."""
    out: list[Block] = []
    run: list[tuple[int, list[Cell]]] = []
    fields: dict[int, str] = {}
    dates = SheetDates(sheet, today)

    def flush() -> None:
        if run and (b := sheet_block(sheet, run, fields)):
            out.append(b)
        run.clear()

    for n, cells in rows:
        if not cells:
            continue
        if not fields and len(cells) >= 2:
            fields = {c.column: c.text for c in cells if longest_field is None or len(c.text) <= longest_field}
        dates.observe(n, cells)
        run.append((n, cells))
        if len(run) >= group:
            flush()
    flush()
    return out, dates.finish(column_name)


def csv_document(title: str, text: str, encoding: str, today: dt.date) -> Document:
    mark = delimiter(text)

    def rows() -> Iterator[tuple[int, list[Cell]]]:
        for n, record in enumerate((r for r in csv.reader(io.StringIO(text, newline=""), delimiter=mark, skipinitialspace=True) if r), 1):
            yield n, [Cell(k, f"{column_name(k)}{n}", v.strip()) for k, v in enumerate(record) if v.strip()]

    blocks, dates = sheet_blocks("CSV", rows(), CSV_ROWS, None, today)
    warnings = [f"encoding {encoding}"] * (encoding != "utf-8") + [f"delimiter {mark!r}"] * (mark != ",")
    return Document(title, blocks, warnings, dates)


class Archive:
    """Entries of a zip file by name in any case, each of a bounded size."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise Unreadable("damaged_archive", str(e)) from e
        self.names = {n.filename.replace("\\", "/").lower(): n for n in self.zip.infolist()}

    def read(self, name: str, most: int = MOST_ENTRY) -> bytes | None:
        """Content of an entry; None if there is none."""
        entry = self.names.get(name.lower())
        if entry is None:
            return None
        if entry.file_size > most:
            raise Unreadable("entry_too_large", f"{name}: {entry.file_size} bytes")
        try:
            with self.zip.open(entry) as f:
                data = f.read(most + 1)
        except (zipfile.BadZipFile, EOFError, RuntimeError, NotImplementedError, OSError) as e:
            raise Unreadable("damaged_archive", f"{name}: {e}") from e
        if len(data) > most:
            raise Unreadable("entry_too_large", name)
        return data

    def xml(self, name: str) -> ElementTree.Element | None:
        data = self.read(name)
        if data is None:
            return None
        if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
            raise Unreadable("damaged_archive", f"{name}: declares entities")
        try:
            return ElementTree.fromstring(data)
        except ElementTree.ParseError as e:
            raise Unreadable("damaged_archive", f"{name}: {e}") from e

    def modified(self) -> dt.datetime | None:
        try:
            return core_modified(self.read("docProps/core.xml", 4 << 20) or b"")
        except Unreadable:
            return None


def kind(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


def attribute(e: ElementTree.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2].lower() == name.lower()), "")


def typed(e: ElementTree.Element, marks: dict[str, str]) -> str:
    """Text of the t elements below e, with marks for other kinds."""
    return "".join((x.text or "") if kind(x) == "t" else marks.get(kind(x), "") for x in e.iter())


def docx_document(title: str, data: bytes, today: dt.date) -> Document:
    archive = Archive(data)
    root = archive.xml("word/document.xml")
    if root is None:
        raise Unreadable("damaged_archive", "no word/document.xml")
    out: list[Block] = []
    above, run, place = Headings(), [], [0, 0]

    def flush() -> None:
        if run:
            out.append(block("\n".join(run), above.path, span(PARAGRAPH, *place)))
        run.clear()

    def level(p: ElementTree.Element, text: str) -> int:
        inner = {kind(x): attribute(x, "val") for x in p.iter() if kind(x) in ("pstyle", "outlinelvl")}
        outline = inner.get("outlinelvl", "")
        if outline.isdigit() and int(outline) <= 8:
            return int(outline) + 1
        style = inner.get("pstyle", "").replace(" ", "").lower()
        if "heading" in style or "标题" in style:
            return next((int(c) for c in style if c in "123456789"), 1)
        return heading_level(text, topics=False)

    def parts(e: ElementTree.Element) -> Iterator[ElementTree.Element]:
        for x in e:
            if kind(x) in ("p", "tbl"):
                yield x
            else:
                yield from parts(x)

    paragraphs = tables = 0
    for e in parts(root):
        if kind(e) == "tbl":
            flush()
            tables += 1
            rows = [[" ".join(typed(c, {"tab": " ", "br": " ", "cr": " ", "p": " "}).split()) for c in r.iter() if kind(c) == "tc"] for r in e.iter() if kind(r) == "tr"]
            rows = [r for r in rows if any(r)]
            if rows:
                out.append(block("\n".join(" | ".join(r) for r in rows), above.path, f"{TABLE} {tables} {ROW_MARK} 1-{len(rows)}"))
            continue
        paragraphs += 1
        text = typed(e, {"tab": "\t", "br": "\n", "cr": "\n"}).strip()
        if not text:
            continue
        if n := level(e, text):
            flush()
            above.enter(n, text)
            continue
        if run and sum(map(len, run)) + len(text) > PARAGRAPHS:
            flush()
        if not run:
            place[0] = paragraphs
        place[1] = paragraphs
        run.append(text)
    flush()
    return Document(title, out, [] if out else ["no text"], block_evidence(out, today), archive.modified(), not out)


def xlsx_document(title: str, data: bytes, today: dt.date) -> Document:
    """Every sheet's cells with their cached values and formulas; formulas are never evaluated, macros never run."""
    archive = Archive(data)
    book, links = archive.xml("xl/workbook.xml"), archive.xml("xl/_rels/workbook.xml.rels")
    if book is None or links is None:
        raise Unreadable("damaged_archive", "no workbook")
    target: dict[str, str] = {}
    for r in links.iter():
        if kind(r) == "relationship" and "external" not in attribute(r, "TargetMode").lower():
            t = attribute(r, "Target").replace("\\", "/")
            target[attribute(r, "Id")] = posixpath.normpath(t.lstrip("/") if t.startswith("/") else posixpath.join("xl", t))
    table = archive.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in s.iter() if kind(t) == "t") for s in table if kind(s) == "si"] if table is not None else []

    def cell(c: ElementTree.Element) -> Cell:
        inner = {k: "".join(x.text or "" for x in c.iter() if kind(x) == k) for k in ("v", "f", "t")}
        raw, cached = inner["v"].strip(), inner["t"].strip() or inner["v"].strip()
        if attribute(c, "t") == "s" and raw.isdigit() and int(raw) < len(shared):
            raw, cached = "", shared[int(raw)]
        cached = " ".join(cached.split())
        return Cell(column_number(attribute(c, "r")), attribute(c, "r"), cached, raw, cached, inner["f"].strip())

    def rows(sheet: ElementTree.Element) -> Iterator[tuple[int, list[Cell]]]:
        for n, r in enumerate((r for r in sheet.iter() if kind(r) == "row"), 1):
            number = attribute(r, "r")
            cells = [x for x in map(cell, (c for c in r if kind(c) == "c")) if x.cached or x.formula]
            yield int(number) if number.isdigit() and int(number) else n, sorted(cells, key=lambda x: x.column)

    out: list[Block] = []
    dates: list[Evidence] = []
    for s in book.iter():
        if kind(s) != "sheet":
            continue
        name = attribute(s, "name")
        sheet = archive.xml(target.get(attribute(s, "id"), ""))
        if sheet is None:
            raise Unreadable("damaged_archive", f"no sheet {name}")
        found, d = sheet_blocks(name, rows(sheet), PROPERTY_ROWS if "属性" in name else SHEET_ROWS, 80, today)
        out += found
        dates += d
    warnings = ["holds macros, which are not run"] * any(n.endswith("vbaproject.bin") for n in archive.names) + ["no cells"] * (not out)
    return Document(title, out, warnings, reconcile_sheets(dates), archive.modified())


def xmind_document(title: str, data: bytes) -> Document:
    """Topics with their notes below the topics above them; children in the file's order."""
    archive, out = Archive(data), []
    sheets = archive.read("content.json")
    if sheets is not None:
        try:
            sheets = json.loads(sheets)
        except ValueError as e:
            raise Unreadable("damaged_archive", f"content.json: {e}") from e
        todo = [(s["rootTopic"], (), (s.get("title") or "").strip() or NO_SHEET) for s in reversed(sheets) if s.get("rootTopic")]
        while todo:
            topic, parents, sheet = todo.pop()
            name = (topic.get("title") or "").strip() or NO_TOPIC
            note = (((topic.get("notes") or {}).get("plain") or {}).get("content") or "").strip()
            path = (*parents, name)
            out.append(block(f"{name}\n{note}" if note else name, path, f"XMind/{sheet}/{'/'.join(path)}"))
            children = [c for group in (topic.get("children") or {}).values() for c in group]
            todo += [(c, path, sheet) for c in reversed(children)]
    elif (root := archive.xml("content.xml")) is not None:
        titles = [t for e in root.iter() if kind(e) == "title" and (t := "".join(e.itertext()).strip())]
        out = [block(t, (t,), f"XMind {n}") for n, t in enumerate(titles, 1)]
    return Document(title, out, [] if out else ["no topics"])


def text_document(title: str, extension: str, data: bytes, today: dt.date) -> Document:
    text, encoding = decode_named(data)
    if extension == ".csv":
        return csv_document(title, text, encoding, today)
    found = html_blocks(text) if extension in (".html", ".htm") else line_blocks(text, extension in (".md", ".markdown"))
    return Document(title, found, [f"encoding {encoding}"] * (encoding != "utf-8"))


def _refused(code: str, message: str) -> Callable[..., Document]:
    def refuse(*_) -> Document:
        raise Unreadable(code, message)

    return refuse


#: How each extension is read: (title, extension, data, today) -> Document. PDF and old binary formats have no reader here.
READERS: dict[str, Callable[[str, str, bytes, dt.date], Document]] = {
    **dict.fromkeys((".md", ".markdown", ".txt", ".json", ".yaml", ".yml", ".html", ".htm", ".csv"), text_document),
    ".docx": lambda title, _, data, today: docx_document(title, data, today),
    **dict.fromkeys((".xlsx", ".xlsm"), lambda title, _, data, today: xlsx_document(title, data, today)),
    ".xmind": lambda title, _, data, __: xmind_document(title, data),
    # workbooks with a wrong extension are read by their content
    ".xls": lambda title, _, data, today: xlsx_document(title, data, today) if data[:2] == b"PK" else _refused("unsupported_format", "binary workbooks have no reader")(),
    ".pdf": _refused("unsupported_format", "PDF has no reader"),
    ".doc": _refused("unsupported_format", "binary documents have no reader; save as .docx"),
}
#: Extensions whose hash is over their chunks: archives differ in bytes where nothing of their content does.
BY_CONTENT = frozenset((".docx", ".xlsx", ".xlsm", ".xmind"))


def read(title: str, extension: str, data: bytes, today: dt.date) -> Document:
    """The document in data; Unreadable if it can't be read or has no text."""
    reader = READERS.get(extension)
    if reader is None:
        raise Unreadable("unsupported_format", f"no reader for {extension!r}")
    try:
        document = reader(title, extension, data, today)
    except (ValueError, KeyError, TypeError, AttributeError, csv.Error) as e:
        raise Unreadable("extract_failed", str(e)) from e
    if not document.blocks and not document.needs_ocr:
        raise Unreadable("extract_failed", "no text to index")
    return document
