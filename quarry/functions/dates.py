"""Business dates in names, version logs and tables, worked out in Python where an order of lines matters.

Dates are valid from 2000 to a year and a day after today, which every function takes as a parameter.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

FIRST, AHEAD = dt.date(2000, 1, 1), dt.timedelta(days=366)
#: Day 0 of spreadsheets.
SERIAL_ZERO = dt.date(1899, 12, 30)
MOST_BLOCKS, MOST_LINES = 300, 2_000

_APART = re.compile(r"(?<!\d)(20\d{2})[-/.年_](0?[1-9]|1[0-2])(?:[-/.月_](0?[1-9]|[12]\d|3[01])日?)?(?!\d)", re.A)
_JOINED = re.compile(r"(?<!\d)(20\d{2})(0[1-9]|1[0-2])([0-2]\d|3[01])(?!\d)", re.A)
_SHORT = re.compile(r"(?<!\d)(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/(\d{2})(?!\d)", re.A)
_SERIAL = re.compile(r"(?<!\d)(\d{5})(?!\d)", re.A)
# What marks dates of versions in lines, tables and sheets.
_DATE_HEADER = re.compile(r"(版本|修订|修改|更新|变更)\s*(日期|时间)|\b(version|revision)\s*(date|time)\b", re.I | re.A)
_FIELD_DATE = re.compile(r"(版本|version)\]?\s*[:：=]\s*20\d{2}", re.I | re.A)
_ACTION = re.compile(r"初版|首版|修改|更新|复用|迭代|变更|revision|changelog", re.I)
_LEADING = re.compile(r"^\s*([#>*-]+\s*)?(版本|version)\]?\s*[:：=]?\s*(20\d{6}|20\d{2}[-/.年_](0?[1-9]|1[0-2])([-/.月_](0?[1-9]|[12]\d|3[01])日?)?)(\D|$)", re.I | re.A)
_COVER = re.compile(r"(版本|version)\s*([:：]|\s+)\s*v?\d+(\.\d+){0,3}\s+20\d{2}", re.I | re.A)
_MARKED_SERIAL = re.compile(r"\[(?:版本|修订|修改|更新|变更)(?:日期|时间)\]\s*=\s*(\d{5})(?!\d)", re.A)
_REVISION_FIELD = re.compile(r"^(?:(修订|版本|修改|更新|变更)\s*)?(日期|时间)$")
_CELL_LABEL = re.compile(r"^[A-Z]+\d*(\[[^\]]*\])?=", re.A)
_SHEET_FIELD = re.compile(r"^(修订|版本|修改|更新|变更)\s*(日期|时间)$|^(版本|version|招募版本|复用版本)$", re.I)
_DATED_SHEET = re.compile(r"版本|修订|更新|迭代|测试内容")
LOG_HEADINGS = {"版本修改记录", "版本记录", "修改记录", "changelog", "revision history"}


@dataclass(frozen=True)
class Evidence:
    """A date of a document's content with where it stands."""

    date: dt.date
    kind: str
    locator: str
    strength: str = "strong"


def valid(year: int, month: int, day: int, today: dt.date) -> dt.date | None:
    try:
        d = dt.date(year, month, day)
    except ValueError:
        return None
    return d if FIRST <= d <= today + AHEAD else None


def _all(pattern: re.Pattern, text: str, make: Callable[[re.Match], dt.date | None]) -> set[dt.date]:
    return {d for m in pattern.finditer(text) if (d := make(m))}


def find_dates(text: str, today: dt.date) -> set[dt.date]:
    """Dates written apart (a missing day is the first) or together."""
    read = lambda m: valid(int(m[1]), int(m[2]), int(m[3] or 1), today)
    return _all(_APART, text, read) | _all(_JOINED, text, read)


def short_year_dates(text: str, today: dt.date) -> set[dt.date]:
    """month/day/yy."""
    return _all(_SHORT, text, lambda m: valid(2000 + int(m[3]), int(m[1]), int(m[2]), today))


def serial_date(serial: int, today: dt.date) -> dt.date | None:
    """The day of a spreadsheet's serial number."""
    if not 0 < serial < 1_000_000:
        return None
    d = SERIAL_ZERO + dt.timedelta(days=serial)
    return valid(d.year, d.month, d.day, today)


def serial_dates(text: str, today: dt.date, pattern: re.Pattern = _SERIAL) -> set[dt.date]:
    return _all(pattern, text, lambda m: serial_date(int(m[1]), today))


def search_date(value: str) -> dt.datetime:
    """A request's date: RFC 3339, or a day at midnight UTC; ValueError otherwise."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value, re.A):
        return dt.datetime.combine(dt.date.fromisoformat(value), dt.time(), dt.UTC)
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2})", value, re.A):
        raise ValueError(f"not a date: {value!r}")
    return dt.datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", value.upper())).astimezone(dt.UTC)


_PDF = re.compile(r"^(?:D:)?(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?(\d{2})?(?:([Zz])|([+-])(\d{2})'?(\d{2})'?)?", re.A)


def pdf_date(value: str) -> dt.datetime | None:
    """A PDF's date, D:YYYYMMDDhhmmss with an offset; None if it is none."""
    m = _PDF.match(value.strip())
    if not m:
        return None
    try:
        zone = dt.timezone((1 if m[8] == "+" else -1) * dt.timedelta(hours=int(m[9]), minutes=int(m[10]))) if m[8] and int(m[10]) < 60 else dt.UTC
        return dt.datetime(*(int(m[i] or 0) for i in range(1, 7)), tzinfo=zone).astimezone(dt.UTC)
    except (ValueError, OverflowError):
        return None


_MODIFIED = re.compile(rb"<(?:\w+:)?modified[^>]*>([^<]*)</", re.I)


def core_modified(core_xml: bytes) -> dt.datetime | None:
    """When an Office file was last changed, by its core properties."""
    m = _MODIFIED.search(core_xml)
    try:
        d = dt.datetime.fromisoformat(m[1].decode().strip()) if m else None
    except ValueError:
        return None
    return d and (d.replace(tzinfo=dt.UTC) if d.tzinfo is None else d.astimezone(dt.UTC))


def block_evidence(blocks: Iterable, today: dt.date) -> list[Evidence]:
    """Dates in the date column of revision tables, and behind a leading version mark, of blocks (text, locator)."""
    found: dict[Evidence, None] = {}

    def add(dates: set[dt.date], kind: str, locator: str) -> None:
        found.update(dict.fromkeys(Evidence(d, kind, locator) for d in sorted(dates)))

    for b in blocks:
        lines = b.text.split("\n")
        rows = [[c.strip() for c in line.split("|")] for line in lines]
        named = ((i, k) for i, row in enumerate(rows) for k, c in enumerate(row) if _REVISION_FIELD.match(_CELL_LABEL.sub("", c).strip()))
        head, column = next(named, (len(rows), 0))
        for row in rows[head + 1 :]:
            if column < len(row):
                add(find_dates(row[column], today), "revision_table", b.locator)
        for line in lines:
            if m := _LEADING.search(line):
                add(find_dates(m[0], today), "leading_version", b.locator)
    return list(found)


def log_dates(source_kind: str, blocks: Iterable, today: dt.date) -> tuple[dt.date | None, dt.date | None]:
    """(latest strong, latest weak) date of a document's version history: one pass over its lines, as from a table's
    header of dates on every line is read. Of tables only sheets that are named as logs count."""
    strong: set[dt.date] = set()
    weak: set[dt.date] = set()
    blocks_left, lines_left, in_table = MOST_BLOCKS, MOST_LINES, False
    for b in blocks:
        logged = source_kind != "table" or any(h.strip().lower() in LOG_HEADINGS for h in b.headings)
        if b.section != "version_history" or not logged:
            continue
        if not blocks_left or not lines_left:
            break
        blocks_left -= 1
        for line in f"{' / '.join(b.headings)} {b.text}".strip().split("\n"):
            if not lines_left:
                break
            lead = _LEADING.search(line)
            if _DATE_HEADER.search(line):
                in_table = True
                strong |= find_dates(line, today) | serial_dates(line, today)
            elif in_table:
                strong |= find_dates(line, today) | serial_dates(line, today, _MARKED_SERIAL)
            elif _FIELD_DATE.search(line) or _ACTION.search(line):
                strong |= find_dates(line, today)
            elif lead:
                strong |= find_dates(lead[0], today)
            elif _COVER.search(line):
                weak |= find_dates(line, today)
            else:
                continue
            lines_left -= 1
    return max(strong, default=None), max(weak, default=None)


class SheetDates:
    """Dates of a sheet, row by row: below a field of dates, in a row of versions with content below, in the sheet's name."""

    def __init__(self, sheet: str, today: dt.date):
        self.sheet, self.today = sheet, today
        self.columns: dict[int, int] = {}
        self.axes: list[tuple[int, dict[int, set[dt.date]], set[int]]] = []
        self.found: dict[Evidence, None] = {}
        if _DATED_SHEET.search(sheet):
            self._add(find_dates(sheet, today), "dated_sheet", sheet)

    def _add(self, dates: Iterable[dt.date], kind: str, locator: str) -> None:
        self.found.update(dict.fromkeys(Evidence(d, kind, locator) for d in sorted(dates)))

    def _of(self, cell) -> set[dt.date]:
        raw = (cell.raw or cell.cached).strip()
        serial = serial_date(int(raw), self.today) if len(raw) == 5 and raw.isascii() and raw.isdigit() else None
        return find_dates(cell.text, self.today) | short_year_dates(cell.text, self.today) | ({serial} if serial else set())

    def observe(self, number: int, cells: list) -> None:
        """cells have column, address, text, cached and raw."""
        for row, dates, content in self.axes:
            content.update(c.column for c in cells if number > row and c.column in dates and c.cached.strip())
        for c in cells:
            if number > self.columns.get(c.column, number):
                self._add(self._of(c), "version_field", f"{self.sheet}!{c.address}")
        fields = [c.column for c in cells if _SHEET_FIELD.match(c.text.strip())]
        self.columns.update(dict.fromkeys(fields, number))
        dated = {c.column: d for c in cells if (d := self._of(c))} if fields else {}
        if len(dated) >= 2:
            self.axes.append((number, dated, set()))

    def finish(self, column_name: Callable[[int], str]) -> list[Evidence]:
        for row, dates, content in self.axes:
            for column in sorted(content):
                self._add(dates[column], "version_axis", f"{self.sheet}!{column_name(column)}{row}")
        return list(self.found)


def reconcile_sheets(evidence: list[Evidence]) -> list[Evidence]:
    """Where two sheets or more have rows of versions, only dates of such rows that two sheets share count, if there are any."""
    sheets: dict[dt.date, set[str]] = {}
    for e in evidence:
        if e.kind == "version_axis" and e.locator.rfind("!") > 0:
            sheets.setdefault(e.date, set()).add(e.locator.rpartition("!")[0])
    shared = {d for d, s in sheets.items() if len(s) > 1}
    if len(set().union(*sheets.values())) < 2 or not shared:
        return evidence
    return [e for e in evidence if e.kind != "version_axis" or e.date in shared]


def resolve(stem: str, directory: str, source_kind: str, blocks: Iterable, evidence: list[Evidence] | None, embedded: dt.datetime | None, modified: dt.datetime, today: dt.date) -> tuple[dt.datetime, str]:
    """(effective date, its source): the file's name, a strong log, the path, a weak log, embedded, file system.

    evidence, where it isn't None, stands for the log, even when empty.
    """
    if evidence is None:
        strong, weak = log_dates(source_kind, blocks, today)
    else:
        of = lambda s: max((e.date for e in evidence if e.strength == s and valid(e.date.year, e.date.month, e.date.day, today)), default=None)
        strong, weak = of("strong"), of("weak")
    named, path = (max(find_dates(x, today), default=None) for x in (stem, directory))
    for day, source in ((named, "filename"), (strong, "version_log"), (path, "path"), (weak, "version_log")):
        if day:
            return dt.datetime.combine(day, dt.time(), dt.UTC), source
    if embedded and FIRST <= embedded.date() and embedded <= dt.datetime.combine(today + AHEAD, dt.time(23, 59, 59), dt.UTC):
        return embedded, "embedded_modified"
    return modified, "filesystem_mtime"


def reads_embedded(stem: str, directory: str, today: dt.date) -> bool:
    """Whether the embedded date can matter: neither name nor path has a date."""
    return not find_dates(stem, today) and not find_dates(directory, today)
