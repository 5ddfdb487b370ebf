"""Excerpts of chunks, and citations that give them back: an identifier names the chunk and what of it was shown, with a
digest over the chunk's content, so that a changed chunk or a damaged identifier is noticed. The digest has no key: it
is no proof against forgery.

Lengths are UTF-16 units throughout; a slice never parts a surrogate pair.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import posixpath
import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.chunking import FIELDS_MARK, LOCATOR, ROW_MARK
from quarry.functions.query import ordered_terms
from quarry.functions.text import fold
from quarry.sources.formats import column_name, column_number

# Characters of an excerpt and the most of a targeted one, columns of one, rows on each side, highlighted terms.
LENGTH, TARGETED_LENGTH, MOST_COLUMNS, AROUND, HIGHLIGHTS = 520, 2_400, 12, 2, 12
# Texts of a table's excerpt.
SHOWN_FIELDS, NO_FIELD = "字段映射（投影）", "未命名字段"
CUT = "…"
PREFIX = "cite:"
_ROW = re.compile(rf"^{ROW_MARK}\s+(\d+)\s*\|\s*(.*)$", re.A)
_SEGMENT = re.compile(r"^([A-Z]+)(?:\d+)?(?:\[[^\]]*\])?=", re.A)
_CHUNK_ID = re.compile(r"^chunk_([0-9a-f]{16})_([0-9a-f]{8})_(\d+)$", re.I | re.A)
MOST_INT = (1 << 31) - 1


class BadCitation(ValueError):
    """The identifier is damaged, or doesn't fit what is stored."""


Slice = tuple[int, int]


@dataclass(frozen=True)
class Scope:
    """What of a sheet's chunk is shown: a range, its columns, and slices of the fields and of the row where one row is cut."""

    locator: str
    columns: tuple[str, ...]
    fields_slice: Slice | None = None
    row_slice: Slice | None = None


@dataclass(frozen=True)
class Excerpt:
    text: str
    locator: str
    scope: Scope | None = None
    slice: Slice | None = None


@dataclass(frozen=True)
class Reference:
    """What an identifier says."""

    chunk_id: str
    kind: str = "chunk"
    payload: bytes = b""
    digest: str = ""
    scope: Scope | None = None
    slice: Slice | None = None
    #: Offsets of a compact scope, from the chunk's own range.
    compact: tuple = ()


# --- text by UTF-16 units


def units(text: str) -> bytes:
    return text.encode("utf-16-le", "surrogatepass")


def length16(text: str) -> int:
    return len(units(text)) // 2


def slice16(text: str, start: int, end: int) -> str:
    """Units start to end, narrowed where an end would part a pair."""
    u = units(text)
    n = len(u) // 2
    if not 0 <= start <= end <= n:
        raise BadCitation(f"slice {start}-{end} of {n}")
    low = lambda i: 0 < i < n and 0xDC <= u[2 * i + 1] <= 0xDF and 0xD8 <= u[2 * i - 1] <= 0xDB
    start += low(start)
    end -= end > start and low(end)
    return u[2 * start : 2 * end].decode("utf-16-le", "surrogatepass") if end > start else ""


def find16(text: str, term: str) -> int:
    """The unit at which term stands, whatever its case; -1 if nowhere."""
    t, w = units(text.lower()), units(term.lower())
    at = t.find(w) if w else -1
    while at > 0 and at % 2:
        at = t.find(w, at + 1)
    return at // 2 if at >= 0 else -1


def shown(text: str, part: Slice) -> str:
    """A slice, trimmed, with marks where text is left out."""
    return f"{CUT if part[0] > 0 else ''}{slice16(text, *part).strip()}{CUT if part[1] < length16(text) else ''}"


def around(text: str, terms: Iterable[str], limit: int) -> tuple[str, Slice]:
    """At most limit units about the first term (in the order of terms) that text holds, a third of them before it."""
    limit, n = max(1, limit), length16(text)
    if n <= limit:
        return text, (0, n)
    at = next((p for t in terms if (p := find16(text, t)) >= 0), None)
    if at is None:
        part = (0, max(0, limit - 1))
        return shown(text, part), part
    body = max(1, limit - 2)
    start = max(0, min(n - body, at - int(body * 0.3)))
    part = (start, min(n, start + max(1, limit - (start > 0) - (start + body < n))))
    out = shown(text, part)
    return (out if length16(out) <= limit else slice16(out, 0, limit)), part


# --- sheets


def cells(line: str) -> list[str]:
    return [c for c in (x.strip() for x in line.split("|")) if c]


def column_of(cell: str) -> str:
    m = _SEGMENT.match(cell)
    return m[1] if m else ""


@dataclass(frozen=True)
class Sheet:
    """A sheet's chunk: its fields by column and its rows' cells."""

    fields: tuple[str, ...]
    rows: tuple[tuple[int, str], ...]

    @classmethod
    def of(cls, text: str) -> Sheet | None:
        lines = [x for x in (x.strip() for x in text.replace("\r\n", "\n").split("\n")) if x]
        head = next((x for x in lines if x.startswith(f"{FIELDS_MARK} |")), None)
        rows = tuple((int(m[1]), m[2]) for x in lines if (m := _ROW.match(x)))
        return cls(tuple(cells(head.removeprefix(f"{FIELDS_MARK} |"))), rows) if head and rows else None

    def head(self, columns: Iterable[str]) -> str:
        named = {column_of(f): f for f in self.fields if column_of(f)}
        return " | ".join([SHOWN_FIELDS, *(named.get(c, f"{c}={NO_FIELD}") for c in columns)])

    @staticmethod
    def line(row: tuple[int, str], columns: Iterable[str]) -> str:
        keep = {"", *columns}
        return " | ".join([f"{ROW_MARK} {row[0]}", *(c for c in cells(row[1]) if column_of(c) in keep)])

    def table(self, rows: Iterable[tuple[int, str]], columns: Iterable[str]) -> str:
        return "\n".join([self.head(columns), *(self.line(r, columns) for r in rows)])


def _place(locator: str) -> tuple[str, int, int, int, int] | None:
    """(sheet, first column, first row, last column, last row) of a range."""
    m = LOCATOR.match(locator)
    return (m[1], column_number(m[2]), int(m[3]), column_number(m[4]), int(m[5])) if m else None


def _sheet_excerpt(text: str, locator: str, terms: list[str], limit: int) -> Excerpt | None:
    place, sheet = _place(locator), Sheet.of(text)
    if not place or not sheet:
        return None
    name, first, top, last, bottom = place
    rows = [r for r in sheet.rows if top <= r[0] <= bottom]
    holds = lambda x: any(t in fold(x) for t in terms)
    folded = [fold(f"{ROW_MARK} {n} | {c}") for n, c in rows]
    center = next((i for t in terms for i, x in enumerate(folded) if t in x), 0)
    low, high = max(0, center - AROUND), min(len(rows), center + AROUND + 1)

    def columns(part: Iterable[tuple[int, str]]) -> tuple[list[str], set[str]]:
        """Columns of the fields and of some rows, in order, and those with a term."""
        found = [c for c in [*sheet.fields, *(c for _, x in part for c in cells(x))] if column_of(c) and first <= column_number(column_of(c)) <= last]
        return sorted({column_of(c) for c in found}, key=column_number), {column_of(c) for c in found if holds(c)}

    order, hit = columns(rows[low:high])
    if not rows or not order:
        return None
    hit |= set(order[:2])
    near = {order[j] for i, c in enumerate(order) if c in hit for j in (i - 1, i, i + 1) if 0 <= j < len(order)}
    chosen = [c for c in order if c in near][:MOST_COLUMNS]
    out = sheet.table(rows[low:high], chosen)
    if limit > LENGTH and length16(out) <= limit:
        # wider: a row below, a row above, and so on while they fit; then columns, those with a term first
        used, grew = length16(out), True
        while grew:
            grew = False
            for i in (high, low - 1):
                more = 1 + length16(sheet.line(rows[i], chosen)) if 0 <= i < len(rows) else limit
                if used + more <= limit:
                    used, grew, low, high = used + more, True, min(low, i), max(high, i + 1)
        order, hit = columns(rows[low:high])
        for c in sorted((c for c in order if c not in chosen), key=lambda c: (c not in hit, column_number(c))):
            trial = sorted([*chosen, c], key=column_number)
            if len(chosen) < MOST_COLUMNS and length16(sheet.table(rows[low:high], trial)) <= limit:
                chosen = trial
        out = sheet.table(rows[low:high], chosen)
    part, slices = rows[low:high], (None, None)
    if length16(out) > limit:
        part = [rows[center]]
        head, a = around(sheet.head(chosen), terms, max(1, min(limit * 35 // 100, limit - 2)))
        line, b = around(sheet.line(part[0], chosen), terms, max(1, limit - length16(head) - 1))
        out, slices = slice16(f"{head}\n{line}", 0, min(limit, length16(head) + 1 + length16(line))), (a, b)
    at = f"{name}!{chosen[0]}{min(r[0] for r in part)}:{chosen[-1]}{max(r[0] for r in part)}"
    return Excerpt(out, at, Scope(at, tuple(chosen), *slices))


def excerpt(text: str, locator: str, terms: Iterable[str], limit: int = LENGTH) -> Excerpt:
    """What is shown of a chunk: of a sheet the rows and columns about the terms, else the text about the first of them."""
    words = ordered_terms(terms)
    limit = limit if limit > 0 else LENGTH
    if found := _sheet_excerpt(text, locator, words, limit):
        return found
    out, part = around(text, words, limit)
    return Excerpt(out, locator, slice=part if part != (0, length16(text)) else None)


def replay(text: str, base: str, scope: Scope) -> str:
    """The excerpt of a sheet's chunk that a scope describes; BadCitation where it doesn't lie in the chunk."""
    own, part, sheet = _place(base), _place(scope.locator), Sheet.of(text)
    if not own or not part or own[0] != part[0] or not sheet:
        raise BadCitation("another sheet")
    numbers = [column_number(c) if re.fullmatch("[A-Z]+", c) else -1 for c in scope.columns]
    inside = own[1] <= part[1] <= part[3] <= own[3] and own[2] <= part[2] <= part[4] <= own[4]
    if not inside or not 1 <= len(numbers) <= MOST_COLUMNS or numbers != sorted(set(numbers)) or (numbers[0], numbers[-1]) != (part[1], part[3]):
        raise BadCitation("a range outside of the chunk")
    rows = [r for r in sheet.rows if part[2] <= r[0] <= part[4]]
    if not rows or (scope.fields_slice is None) != (scope.row_slice is None) or (scope.row_slice and len(rows) != 1):
        raise BadCitation("rows that aren't there")
    if scope.row_slice is None:
        return sheet.table(rows, scope.columns)
    return f"{shown(sheet.head(scope.columns), scope.fields_slice)}\n{shown(sheet.line(rows[0], scope.columns), scope.row_slice)}"


# --- identifiers


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def _unb64(text: str) -> bytes:
    try:
        out = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    except (binascii.Error, ValueError) as e:
        raise BadCitation("not base64") from e
    if _b64(out) != text:
        raise BadCitation("not base64 as it is written")
    return out


def varints(values: Iterable[int]) -> bytes:
    """Seven bits a byte, lowest first."""
    out = bytearray()
    for v in values:
        if not 0 <= v <= MOST_INT:
            raise BadCitation(f"number {v}")
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def read_varints(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        if not b & 128:
            if value > MOST_INT:
                raise BadCitation("number too large")
            out.append(value)
            value = shift = 0
        elif shift >= 35:
            raise BadCitation("number too long")
    if shift:
        raise BadCitation("cut short")
    return out


def digest(kind: str, content_hash: str, payload: bytes, chunk_id: str = "") -> str:
    """22 characters over the chunk's content and what is shown of it."""
    named = chunk_id.encode() + b"\0" if chunk_id else b""
    return _b64(hashlib.sha256(f"citation-{kind}\0".encode() + named + content_hash.encode() + b"\0" + payload).digest())[:22]


def _head(chunk_id: str) -> tuple[bytes, int] | None:
    m = _CHUNK_ID.match(chunk_id)
    return (bytes.fromhex(m[1] + m[2]), int(m[3])) if m else None


def _wide(scope: Scope) -> bytes:
    value = {"v": 1, "l": scope.locator, "c": list(scope.columns)} | ({"h": list(scope.fields_slice), "r": list(scope.row_slice)} if scope.row_slice else {})
    return _b64(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()).encode()


def identifier(chunk_id: str, locator: str, content_hash: str, shown_: Excerpt | None = None, prefix: str = PREFIX) -> str:
    """The citation of a chunk, or of what is shown of it: compact where the chunk's own id is, else spelled out."""
    if shown_ is None or (shown_.scope is None and shown_.slice is None):
        return prefix + chunk_id
    head = _head(chunk_id)
    if shown_.slice is not None:
        a, b = shown_.slice
        if head is None or not 0 <= a < b:
            raise BadCitation("a slice that can't be written")
        payload = head[0] + varints([head[1], a, b - a])
        return f"{prefix}3.{_b64(payload)}.{digest('text', content_hash, payload)}"
    scope, own, part = shown_.scope, _place(locator), _place(shown_.scope.locator)
    if head is None or own is None or part is None or own[0] != part[0]:
        payload = _wide(scope)
        return f"{prefix}{chunk_id}~{payload.decode()}.{digest('scope', content_hash, payload, chunk_id)}"
    numbers = [own[1], *map(column_number, scope.columns)]
    steps = [b - a for a, b in zip(numbers, numbers[1:], strict=False)]
    if not scope.columns or min(steps[1:], default=1) < 1 or (scope.fields_slice is None) != (scope.row_slice is None):
        raise BadCitation("a scope that can't be written")
    cut = [x for s in (scope.fields_slice, scope.row_slice) if s for x in (s[0], s[1] - s[0])]
    payload = head[0] + varints([head[1], 1 if cut else 0, part[2] - own[2], part[4] - part[2], len(scope.columns), *steps, *cut])
    return f"{prefix}2.{_b64(payload)}.{digest('sheet', content_hash, payload)}"


def parse(citation: str, prefix: str = PREFIX) -> Reference:
    """What an identifier says; BadCitation if it is damaged. Whether the digest fits is seen with the chunk."""
    value = citation.removeprefix(prefix)
    if m := re.fullmatch(r"([23])\.([A-Za-z0-9_-]{1,512})\.([A-Za-z0-9_-]+)", value):
        payload = _unb64(m[2])
        numbers = read_varints(payload[12:])
        if len(payload) < 15 or len(numbers) < 3:
            raise BadCitation("cut short")
        chunk_id = f"chunk_{payload[:8].hex()}_{payload[8:12].hex()}_{numbers[0]}"
        if m[1] == "3":
            if len(numbers) != 3 or numbers[2] < 1:
                raise BadCitation("a slice that isn't one")
            return Reference(chunk_id, "text", payload, m[3], slice=(numbers[1], numbers[1] + numbers[2]))
        flag, n = numbers[1], numbers[4] if len(numbers) > 4 else 0
        if flag > 1 or not 1 <= n <= MOST_COLUMNS or len(numbers) != 5 + n + 4 * flag or min(numbers[6 : 5 + n], default=1) < 1:
            raise BadCitation("a scope that isn't one")
        return Reference(chunk_id, "sheet", payload, m[3], compact=tuple(numbers[2:]))
    if value[:2] in ("2.", "3."):
        raise BadCitation("not written as such identifiers are")
    chunk_id, mark, token = value.partition("~")
    if not mark:
        return Reference(value)
    text, _, check = token.rpartition(".")
    try:
        wire = json.loads(_unb64(text))
        cut = [tuple(wire[k]) if k in wire else None for k in ("h", "r")]
        if wire["v"] != 1 or not wire["l"] or not wire["c"] or not chunk_id or len(token) > 4096 or any(s is not None and (len(s) != 2 or not all(isinstance(x, int) for x in s)) for s in cut):
            raise BadCitation("a scope that isn't one")
        return Reference(chunk_id, "scope", text.encode(), check, Scope(wire["l"], tuple(wire["c"]), *cut))
    except (ValueError, KeyError, TypeError) as e:
        raise BadCitation("a scope that isn't one") from e


def _spelled(ref: Reference, locator: str) -> Scope:
    """The scope of a compact reference, from the chunk's own range."""
    own = _place(locator)
    if own is None:
        raise BadCitation("not a sheet's chunk")
    down, rows, n, *rest = ref.compact
    numbers = [own[1] + rest[0]]
    for step in rest[1:n]:
        numbers.append(numbers[-1] + step)
    names, top = tuple(map(column_name, numbers)), own[2] + down
    cut = rest[n:]
    slices = ((cut[0], cut[0] + cut[1]), (cut[2], cut[2] + cut[3])) if cut else (None, None)
    return Scope(f"{own[0]}!{names[0]}{top}:{names[-1]}{top + rows}", names, *slices)


def recall(ref: Reference, chunk: dict, citation: str = "", prefix: str = PREFIX) -> Excerpt:
    """What a reference shows of its chunk (text, locator, content_hash); BadCitation where the digest or the range doesn't fit."""
    if ref.kind == "chunk":
        return Excerpt(chunk["text"], chunk["locator"])
    if digest(ref.kind, chunk["content_hash"], ref.payload, ref.chunk_id if ref.kind == "scope" else "") != ref.digest:
        raise BadCitation("the digest doesn't fit")
    if ref.kind == "text":
        out = Excerpt(shown(chunk["text"], ref.slice), chunk["locator"], slice=ref.slice)
    else:
        scope = ref.scope or _spelled(ref, chunk["locator"])
        out = Excerpt(replay(chunk["text"], chunk["locator"], scope), scope.locator, scope)
    if citation.startswith(prefix) and ref.kind != "scope" and identifier(ref.chunk_id, chunk["locator"], chunk["content_hash"], out, prefix) != citation:
        raise BadCitation("another way to write the same")
    return out


def source_link(path: str, locator: str) -> dict:
    """Name, label and Markdown link of a place in a file."""
    name = posixpath.basename(path.replace("\\", "/"))
    label = name.replace("\\", r"\\").replace("[", r"\[").replace("]", r"\]")
    return {"name": name, "label": f"{name} · {locator}", "markdown": f"[{label}](<{path.replace(chr(92), '/').replace('>', '%3E')}>) · `{locator.replace('`', chr(39))}`"}


def highlighted(text: str, terms: Iterable[str]) -> str:
    """text with its longest terms between asterisks, one term after the other."""
    for t in sorted(dict.fromkeys(x for x in terms if x.strip()), key=len, reverse=True)[:HIGHLIGHTS]:
        text = re.sub(re.escape(t), lambda m: f"**{m[0]}**", text, flags=re.I)
    return text


# --- Columns

SHOWN = "struct<text:string,locator:string,citation:string,highlighted:string>"


def excerpts(text: Column, locator: Column, chunk_id: Column, content_hash: Column, terms: list[str], limit: int = LENGTH, prefix: str = PREFIX) -> Column:
    """SHOWN of chunks: meant for the few rows of a result."""

    def make(t: pd.Series, at: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        rows = []
        for text_, locator_, id_, hash_ in zip(t, at, ids, hashes, strict=True):
            e = excerpt(text_ or "", locator_ or "", terms, limit)
            rows.append((e.text, e.locator, identifier(id_, locator_ or "", hash_, e, prefix), highlighted(e.text, terms)))
        return pd.DataFrame(rows, columns=["text", "locator", "citation", "highlighted"])

    return F.pandas_udf(make, SHOWN)(text, locator, chunk_id, content_hash)


def read_citation(documents: DataFrame, chunks: DataFrame, citation: str, revision: int, expected: int | None = None, sources: list[str] | None = None, prefix: str = PREFIX) -> dict:
    """What a citation shows, from the stored tables; BadCitation if it is damaged, LookupError if its chunk or source is gone.

    changed says whether the index has moved on since the expected revision.
    """
    ref = parse(citation, prefix)
    own = documents.where(~F.col("deleted")) if sources is None else documents.where(~F.col("deleted") & F.col("source_id").isin(sources))
    row = chunks.where(F.col("chunk_id") == ref.chunk_id).join(own.select("doc_id", "title", "path", "relative_path", "source_id", "source_kind", "stale"), "doc_id").first()
    if row is None:
        raise LookupError(f"no chunk of a source in use: {citation}")
    out = recall(ref, row.asDict(), citation, prefix)
    section = row.headings[-1] if row.headings else row.section
    return {
        "citation": identifier(ref.chunk_id, row.locator, row.content_hash, replace(out), prefix) if ref.kind != "scope" else citation, "content": out.text, "locator": out.locator, "display": f"{row.title} · {section} · {out.locator}",
        "doc_id": row.doc_id, "chunk_id": row.chunk_id, "source_id": row.source_id, "source_kind": row.source_kind, "stale": row.stale, "link": source_link(row.path, out.locator), "revision": revision, "changed": expected is not None and expected != revision,
    }
