"""Blocks in chunks: long text in overlapping pieces, cut after the end of a sentence where one lies in a piece's second
half; sheets in runs of whole rows, each below the sheet's fields."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import functions as F

from quarry.functions.text import fold, section_of

# Characters of a piece, of the overlap, of merged chunks and their overlap; ends of sentences.
TARGET, OVERLAP, MERGED, MERGED_OVERLAP = 16_000, 320, 32_000, 256
ENDS = re.compile("[。！？!?；;\n]")
# What a sheet's chunk looks like.
FIELDS_MARK, ROW_MARK = "字段", "行"
LOCATOR = re.compile(r"^(.*)!([A-Z]+)([0-9]+):([A-Z]+)([0-9]+)$", re.S)
ROW = re.compile(rf"^{ROW_MARK}\s+([0-9]+)\s*\|", re.A)


@dataclass(frozen=True)
class Block:
    """A piece of a document as an extractor finds it; a chunk once it is cut."""

    text: str
    headings: tuple[str, ...] = ()
    section: str = ""
    locator: str = ""


def pieces(text: str | None, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    t, out, at = (text or "").strip(), [], 0
    while at < len(t):
        cut = min(len(t), at + target)
        if cut < len(t):
            ends = [m.end() for m in ENDS.finditer(t, at + target // 2, cut)]
            cut = ends[-1] if ends else cut
        if piece := t[at:cut].strip():
            out.append(piece)
        if cut >= len(t):
            break
        at = max(at + 1, cut - overlap)
    return out


def sheet_pieces(text: str, locator: str, target: int = TARGET) -> list[tuple[str, str]]:
    """(text, locator) of runs of whole rows of a sheet's block, each with its fields; none if it isn't such a block."""
    at, lines = LOCATOR.match(locator), [x.strip() for x in text.strip().split("\n")]
    rows = [(int(m[1]), x) for x in lines[1:] if (m := ROW.match(x)) and int(m[1]) > 0]
    if not at or not rows or not lines[0].startswith(f"{FIELDS_MARK} |"):
        return []
    sheet, first, _, last, _ = at.groups()
    runs: list[list[tuple[int, str]]] = []
    size = target + 1
    for row in rows:
        if size + len(row[1]) + 1 > target:
            runs.append([])
            size = len(lines[0])
        runs[-1].append(row)
        size += len(row[1]) + 1
    return [("\n".join([lines[0], *(x for _, x in run)]), f"{sheet}!{first}{run[0][0]}:{last}{run[-1][0]}") for run in runs]


def chunks(blocks: Iterable[Block]) -> list[Block]:
    """The blocks' chunks in order; blocks without text have none."""
    out = []
    for b in blocks:
        clean = b.text.replace("\r\n", "\n").strip()
        section = b.section or (section_of(b.headings, clean) if clean else "")
        parts = sheet_pieces(clean, b.locator) or [(p, b.locator) for p in pieces(clean)]
        out += [Block(text, b.headings, section, locator) for text, locator in parts if fold(text)]
    return out


def merged_locator(left: str, right: str) -> str | None:
    """One range for two of the same sheet."""
    a, b = LOCATOR.match(left), LOCATOR.match(right)
    return f"{a[1]}!{a[2]}{a[3]}:{b[4]}{b[5]}" if a and b and a[1] == b[1] else None


def coalesced(parts: list[Block]) -> list[Block]:
    """Neighbouring chunks of one section, heading and place as one again, without what they overlap, cut anew."""
    out: list[Block] = []
    for b in parts:
        last = out[-1] if out else None
        place = last and merged_locator(last.locator, b.locator)
        if not last or (last.section, last.headings) != (b.section, b.headings) or not (place or last.locator == b.locator) or len(last.text) + len(b.text) > MERGED:
            out.append(b)
            continue
        common = next((n for n in range(min(MERGED_OVERLAP, len(last.text), len(b.text)), 0, -1) if last.text.endswith(b.text[:n])), 0)
        out[-1] = replace(last, text=last.text + b.text[common:], locator=place or last.locator)
    return chunks(out) if len(parts) > 1 else parts


def chunk_udf(target: int = TARGET, overlap: int = OVERLAP):
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: pieces(t, target, overlap))

    return F.pandas_udf(cut, "array<string>")
