"""Activities by name and number in titles and texts, and whether a text declares itself the rerun of one.

Names are compared without marks and spaces. A declaration counts only where nothing qualifies it: no word of reference,
open quote or question about it, and no heading of references above it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

from quarry.functions.query import Named
from quarry.functions.text import fold

# Words of reruns, what a document calls itself, and what may stand between.
MARKERS = ("返场", "复刻", "复用", "重开")
SUBJECTS = ("本次活动", "本活动", "本次", "本期", "此次", "这次", "本版本")
CONNECTORS = ("作为", "为", "是")
# Words of reference, documents, questions; ends of statements, clauses and questions.
REFERENCES = ("参考", "参照", "借鉴", "类似", "对标", "仿照", "对照")
DOCUMENTS = ("方案", "策划", "文档", "案", "稿")
TAGS = ("对吗", "是吗", "对不对", "是不是", "对么", "是么", "对吧", "是吧")
LEADS, CLAUSE, QUESTION_ENDS, SENTENCE = "\n|=·•●*-#。；;！!？?、.)）]】", "\n|=。；;！!？?", "\n|。；;！!？?，,", "。，,；;！!？?"
SHORT, AROUND = 16, 16

_ANY = lambda words: "|".join(map(re.escape, words))
_MARK, _REFERENCE = f"(?:{_ANY(MARKERS)})", re.compile(_ANY(REFERENCES))
_SUBJECT = f"(?:{_ANY(SUBJECTS)})(?:{_ANY(CONNECTORS)})?"
_SUBJECT_MARK, _SUBJECT_END, _SELF = re.compile(f"{_SUBJECT}{_MARK}$"), re.compile(f"{_SUBJECT}$"), re.compile(_ANY(SUBJECTS))
_AFTER = re.compile(f" *(?:活动 *)?的?{_MARK}")
_DOCUMENT = re.compile(_ANY(DOCUMENTS))
_TITLE = re.compile(f"(?<!非)(?<!不是)(?<!不){_MARK}")
#: Beginnings of list items by kind, and of sections.
_ITEMS = [re.compile(p, re.A) for p in (r"[·•●*\-]", r"\d+[.、)]", r"\(\d+\)", r"[一二三四五六七八九十]+[、.]", r"#+")]
_SECTION = re.compile(r"#+|[一二三四五六七八九十]+[、.]")
_SHEET_ROW, _CELL = re.compile(r"行 \d+ \|", re.A), re.compile(r"([a-z]+)(?:\[[^\]]*\])?=")
QUOTES = (("“", "”"), ("「", "」"), ("『", "』"))


def _han(c: str) -> bool:
    return "CJK" in unicodedata.name(c, "") or c in "〇々"


def _kept(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def compact(value: str) -> tuple[str, list[bool]]:
    """Letters and digits of a folded value, and for each whether it goes on a run of Han characters."""
    out, joined, before = [], [], False
    for c in fold(value):
        han = _kept(c) and _han(c)
        if _kept(c):
            out.append(c)
            joined.append(han and before)
        before = han
    return "".join(out), joined


def _places(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while part and at >= 0:
        yield at
        at = text.find(part, at + len(part))


def match(value: str, group: Named) -> tuple[float, bool]:
    """(score, embedded): 4 for name and number together, 3.5 to 2 for the number later, by the bytes between."""
    c, joined = compact(value)
    at = c.find(group.entity + group.number)
    if at >= 0:
        return 4.0, joined[at]
    at = c.find(group.entity)
    till = c.find(group.number, at + len(group.entity)) if at >= 0 else -1
    if till < 0:
        return 0.0, False
    gap = len(c[at + len(group.entity) : till].encode())
    return max(2.0, 3.5 - min(1.5, gap / 8)), joined[at]


def names_standalone(value: str, name: str) -> bool:
    """Whether the name stands in value as no part of a longer one."""
    c, joined = compact(value)
    return any(not joined[at] for at in _places(c, name))


def spans(value: str, group: Named) -> list[str]:
    """Names that begin with the group's as no part of a longer one, up to its number."""
    c, joined = compact(value)
    ends = [(at, c.find(group.number, at + len(group.entity))) for at in _places(c, group.entity) if not joined[at]]
    return [c[at : end + len(group.number)] for at, end in ends if end >= 0]


def title_declares(title: str) -> bool:
    """Whether a title says rerun, and not that it is none."""
    return bool(_TITLE.search(title))


@dataclass(frozen=True)
class Cell:
    text: str
    column: int

    @property
    def item(self) -> int:
        """Kind of list item, from 1; 0 if it is none."""
        return next((k for k, p in enumerate(_ITEMS, 1) if p.match(self.text)), 0)

    def heading(self, alone: bool, followed: bool) -> bool | None:
        """Whether it heads references; None if it is no heading. A field with its value beside it is none."""
        refers = bool(_REFERENCE.search(self.text))
        bare = _ITEMS[self.item - 1].sub("", self.text, count=1).strip() if self.item else self.text
        speaks = refers or bool(_SELF.match(bare))
        if _SECTION.match(self.text):
            return refers
        if self.text[-1] in "：:":
            return refers if speaks or not followed else None
        short = alone and len(self.text) <= SHORT and not any(c in self.text for c in SENTENCE)
        return refers if short and speaks else None


def cells(line: str) -> list[Cell]:
    """A line's cells with text: of a sheet by its letters, of other tables by place, else the line itself."""
    sheet = bool(_SHEET_ROW.match(line.strip()))
    out = []
    for k, part in enumerate(line.split("|")[1:] if sheet else line.split("|")):
        part, column = part.strip(), k
        if m := _CELL.match(part):
            if sheet:
                column = sum((ord(c) - 96) * 26**i for i, c in enumerate(reversed(m[1])))
            part = part[m.end() :].strip()
        if part:
            out.append(Cell(part, column))
    return out


def line_heading(row: list[Cell]) -> bool | None:
    """heading() of the last cell of a line that is one."""
    beside = [b.column == a.column + 1 for a, b in zip(row, row[1:], strict=False)] + [False] * (len(row) > 0)
    found = (c.heading(len(row) == 1, f) for c, f in zip(reversed(row), reversed(beside), strict=True))
    return next((h for h in found if h is not None), None)


def heads_references(heading: str) -> bool:
    """Whether a section's own heading is one of references."""
    return line_heading(cells(fold(heading))) is True


class Spelled:
    """A text, folded line by line, in which names are found whatever stands between their characters."""

    def __init__(self, text: str):
        self.text = "\n".join(x for x in map(fold, text.split("\n")) if x)
        self.at = [i for i, c in enumerate(self.text) if _kept(c)]
        self.letters = "".join(self.text[i] for i in self.at)

    def find(self, name: str) -> Iterator[tuple[int, int]]:
        """(first, end) of every occurrence, overlapping ones too."""
        k = self.letters.find(name)
        while name and k >= 0:
            yield self.at[k], self.at[k + len(name) - 1] + 1
            k = self.letters.find(name, k + 1)

    def _since(self, at: int, ends: str) -> int:
        return 1 + max(self.text.rfind(c, 0, at) for c in ends)

    def _until(self, at: int, ends: str) -> int:
        return min((p for c in ends if (p := self.text.find(c, at)) >= 0), default=len(self.text))

    def _declares(self, first: int, end: int) -> bool:
        before, after = self.text[max(0, first - 64) : first].rstrip(" "), self.text[end : end + 16]
        rerun = _AFTER.match(after)
        if _SUBJECT_MARK.search(before) or (rerun and _SUBJECT_END.search(before)):
            return True
        leads = first == 0 or before[-1:] in tuple(LEADS)
        return bool(rerun) and leads and not _DOCUMENT.match(after, rerun.end())

    def _asked(self, end: int) -> bool:
        stop = self._until(end, QUESTION_ENDS)
        mark = self.text[stop : stop + 1]
        if "吗" in self.text[end:stop] or mark in ("？", "?"):
            return True
        then = self._until(stop + 1, QUESTION_ENDS)
        return mark in ("，", ",") and self.text[then : then + 1] in ("？", "?") and self.text[stop + 1 : then].strip() in TAGS

    def _quoted(self, first: int) -> bool:
        cell = self.text[self._since(first, "\n|") : first]
        return any(cell.count(a) > cell.count(b) for a, b in QUOTES) or cell.count('"') % 2 == 1

    def _below_references(self, first: int, end: int) -> bool:
        """Whether the nearest heading before is one of references: in the line, then in the lines above, but for items beside."""
        start = self._since(first, "\n")
        own = cells(self.text[start:end])
        kind = own[-1].item if own else 0
        for i in range(len(own) - 2, -1, -1):
            beside = own[i + 1].column == own[i].column + 1 and (i < len(own) - 2 or not kind)
            if (h := own[i].heading(False, beside)) is not None:
                return h
        for line in reversed(self.text[: max(0, start - 1)].split("\n")):
            row = cells(line)
            h = line_heading(row)
            if h is not None and (h or not kind or row[0].item != kind):
                return h
        return False

    def _around(self, first: int, end: int) -> str:
        a, b = max(0, first - AROUND), min(len(self.text), end + AROUND)
        cut, stop = self._since(first, "=|\n"), self._until(end, "|\n")
        head, tail = ("…" if a > 0 else "", "…" if b < len(self.text) else "")
        if cut > a:
            a, head = cut, ""
        if stop < b:
            b, tail = stop, ""
        return f"{head}{self.text[a:b].strip()}{tail}"

    def declared(self, name: str) -> str | None:
        """The words in which the text declares itself a rerun of name; None if it doesn't."""
        for first, end in self.find(name):
            if not self._declares(first, end) or _REFERENCE.search(self.text[self._since(first, CLAUSE) : first]):
                continue
            if not self._quoted(first) and not self._asked(end) and not self._below_references(first, end):
                return self._around(first, end)
        return None


def rerun_of(title: str, heading: str, text: str, earlier: list[str], names: list[tuple[str, str]]) -> tuple[str, str | None] | None:
    """(name, words of the declaration or None) of a document that leaves the number out of its title; None if it names none.

    names are (full name, name without number) of known activities. The title must have the name without number and, for a
    declaration, say rerun itself; the text must have the full name. earlier chunks of the same section may head references.
    """
    found: tuple[str, str | None] | None = None
    spelled = None
    for name, bare in names:
        if not names_standalone(title, bare):
            continue
        spelled = spelled or Spelled(text)
        if next(spelled.find(name), None) is None:
            continue
        words = spelled.declared(name) if title_declares(title) and not heads_references(heading) else None
        if words is not None and earlier:
            words = Spelled("\n".join([*earlier, text])).declared(name)
        if words is not None:
            return name, words
        found = found or (name, None)
    return found
