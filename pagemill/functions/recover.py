"""Recovery of characters that were lost in an extracted text, from the text layer of its page.

Two ways, both of which give up unless the answer is unique: by the context on both
sides of a lost character, and by an alignment of the whole block with the page.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LOST = "�"
#: Scores: a match, a lost character against any, a mismatch, a gap (fixed values).
MATCH, WILD, MISMATCH, GAP = 3, 2, -3, -2
CONFIDENCE, LEAD, LEAD_SHARE = 0.985, 12, 0.02
MOST_CELLS, MOST_FIRST_CELLS = 8_000_000, 4_000_000
#: Widths of the context, and how far it reaches.
WIDTHS, REACH = (32, 24, 16, 12, 10, 8), 96

_GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
_LETTERS = dict(zip(_GREEK, "αβγδεζηθικλμνξοπρστυφχψω"))
_MARKUP = set("$*_{}^`")
_ACTIVE = set("\\`*_{}[]<>#$&")


def units(text: str) -> list[str]:
    """Characters by which texts are compared: compatibility form, lower case, no blanks."""
    return [c for c in unicodedata.normalize("NFKC", text).lower() if not c.isspace()]


def is_glyph(c: str) -> bool:
    """A single letter, number, symbol or mark that means nothing in Markdown."""
    return len(c) == 1 and c != LOST and unicodedata.category(c)[0] in "LNSM" and c not in _ACTIVE and len(units(c)) == 1


def source_units(text: str) -> list[tuple[str, int]]:
    """Units of a block with their places; markup is skipped, names of Greek letters are the letters."""
    out: list[tuple[str, int]] = []
    for m in re.finditer(r"\\([A-Za-z]+)|\\|([\s\S])", text):
        if m[1]:
            out.extend((u, m.start()) for u in units(_LETTERS.get(m[1].lower(), "")))
        elif m[2] and m[2] not in _MARKUP:
            out.extend((u, m.start()) for u in ([LOST] if m[2] == LOST else units(m[2])))
    return out


def _scores(source: np.ndarray, page: np.ndarray, wild: np.ndarray) -> np.ndarray:
    """All scores of aligning the whole source with a part of the page; a row for each source unit.

    The gap along a row is a running maximum: cell + 2j only grows to the right.
    """
    n, m = len(source), len(page)
    slope = -GAP * np.arange(m + 1, dtype=np.int32)
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(1, n + 1):
        row = table[i - 1] + GAP
        step = WILD if wild[i - 1] else np.where(page == source[i - 1], MATCH, MISMATCH).astype(np.int32)
        row[1:] = np.maximum(row[1:], table[i - 1, :-1] + step)
        table[i] = np.maximum.accumulate(row + slope) - slope
    return table


@dataclass
class Alignment:
    text: str | None
    confidence: float
    cells: int
    exceeded: bool = False


def align(block: str, page: str, most_cells: int = MOST_CELLS) -> Alignment:
    """The block with its lost characters filled from the page, or no text.

    The whole block must align well with one place of the page, no other place may
    come near, and all best alignments must agree on each lost character.
    """
    source = source_units(block)
    glyphs = [(u, g) for g in page for u in units(g)]
    wild = np.array([u == LOST for u, _ in source], bool)
    if not source or not glyphs or not wild.any():
        return Alignment(None, 0.0, 0)
    cells = (len(source) + 1) * (len(glyphs) + 1)
    if cells > min(MOST_FIRST_CELLS, most_cells):
        return Alignment(None, 0.0, 0, True)
    a, b = np.array([ord(u) for u, _ in source], np.int64), np.array([ord(u) for u, _ in glyphs], np.int64)
    t = _scores(a, b, wild)
    full = int(MATCH * (~wild).sum() + WILD * wild.sum())
    best = int(t[-1].max())
    ends = np.flatnonzero(t[-1] == best)
    if len(ends) != 1 or ends[0] == 0 or best / full < CONFIDENCE:
        return Alignment(None, max(0.0, best / full), cells)
    # walk back over the cells of all best alignments, row by row
    live, found = {int(ends[0])}, {}
    for i in range(len(source), 0, -1):
        below: set[int] = set()
        todo = sorted(live, reverse=True)
        seen = set(todo)
        while todo:
            j = todo.pop(0)
            v = t[i, j]
            if j and v == t[i, j - 1] + GAP and j - 1 not in seen:
                seen.add(j - 1)
                todo.append(j - 1)
            if v == t[i - 1, j] + GAP:
                if wild[i - 1]:
                    return Alignment(None, best / full, cells)
                below.add(j)
            step = WILD if wild[i - 1] else MATCH if j and a[i - 1] == b[j - 1] else MISMATCH
            if j and v == t[i - 1, j - 1] + step:
                below.add(j - 1)
                if wild[i - 1]:
                    glyph = glyphs[j - 1][1]
                    if not is_glyph(glyph) or found.setdefault(source[i - 1][1], glyph) != glyph:
                        return Alignment(None, best / full, cells)
        live = below
    if len(live) != 1 or len(found) != block.count(LOST):
        return Alignment(None, best / full, cells)
    start, end = live.pop(), int(ends[0])
    more = (len(source) + 1) * (start + 1 + len(glyphs) - end + 1)
    if cells + more > most_cells:
        return Alignment(None, best / full, cells, True)
    rival = max(int(_scores(a, b[:start], wild)[-1].max()), int(_scores(a, b[end:], wild)[-1].max()))
    if best - rival < max(LEAD, -(-full * LEAD_SHARE // 1)):
        return Alignment(None, best / full, cells + more)
    return Alignment("".join(found.get(i, c) for i, c in enumerate(block)), best / full, cells + more)


def _loose(text: str) -> str:
    return r"\s*".join(map(re.escape, "".join(text.split())))


def _symbol(text: str) -> str | None:
    """One to four letters, numbers, symbols or marks; a doubled half counts once."""
    s = "".join(text.split())
    if len(s) >= 2 and len(s) % 2 == 0 and s[: len(s) // 2] * 2 == s:
        s = s[: len(s) // 2]
    return s if 1 <= len(s) <= 4 and all(unicodedata.category(c)[0] in "LNSM" for c in s) else None


def _from_context(block: str, at: int, page: str) -> str | None:
    import regex

    left = "".join(block[max(0, at - REACH) : at].split())
    right = "".join(block[at + 1 : at + 1 + REACH].split())
    hole = r"\s*([\p{L}\p{N}\p{S}\p{M}\s]{1,12}?)\s*"
    for n in WIDTHS:
        if len(left) >= n and len(right) >= n:
            hits = regex.findall(_loose(left[-n:]) + hole + _loose(right[:n]), page)
            if len(hits) == 1 and (got := _symbol(hits[0])):
                return got
    if right[:1] in (")", "]", "}") and right and len(right[:28]) >= 16:
        hits = regex.findall(hole[3:] + _loose(right[:28]), page)
        return _symbol(hits[0]) if len(hits) == 1 else None
    return None


def from_context(block: str, page: str) -> str | None:
    """The block with all lost characters filled by their context, or None if one of them can't be."""
    out, ok = [], True
    for i, c in enumerate(block):
        got = _from_context(block, i, page) if c == LOST else c
        ok = ok and got is not None
        out.append(got or "")
    return "".join(out) if ok else None


def recovered(block: Column, page: Column, method: str = "alignment") -> Column:
    """The recovered text of each row, null where it is not unique; for blocks of at most 20,000 characters and 32 losses."""

    @F.pandas_udf("string")
    def run(blocks: pd.Series, pages: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> str | None:
            if not x or not y or len(x) > 20_000 or not 0 < x.count(LOST) <= 32:
                return None
            return align(x, y).text if method == "alignment" else from_context(x, y)

        return pd.Series([one(x, y) for x, y in zip(blocks, pages)], dtype=object)

    return run(block, page)


def compact(text: str) -> str:
    """Letters and numbers by which evidence is compared."""
    plain = re.sub(r"&(?:[A-Za-z][A-Za-z0-9]+|#\d+|#x[\dA-Fa-f]+);", " ", re.sub(r"<[^>]*>", "", unicodedata.normalize("NFKC", text)))
    return re.sub(r"[\W_]+", "", plain.lower())


def recovered_paragraph(article: str, before: str, after: str, page: str) -> str | None:
    """The paragraph that belongs between two neighbours, from the text of its region, or None.

    It must look like a complete paragraph, be new to the article, and hold neither
    neighbour; the gap between the neighbours must be blank.
    """
    text = re.sub(r"([^\W_])[-‐‑]\s+([^\W_])", r"\1\2", page.replace("­", ""))
    text = " ".join(text.split())
    at = article.find(before)
    gap = article[at + len(before) : article.find(after, at + len(before))] if at >= 0 and article.find(after, at + len(before)) >= 0 else "x"
    words = re.findall(r"[^\W_]+", text)
    solid = "".join(text.split())
    whole = (
        48 <= len(text) <= 6000 and LOST not in text and re.match(r"[\"'“‘(\[]*(?:[A-ZÀ-ÖØ-Þ]|\d[^\W\d_])", text) and re.search(r"[.!?。！？][\"'”’)\]}]*$", text)
        and not re.match(r"(?i)\s*(?:fig(?:ure)?\.?|(?:extended\s+data|supplementary|supporting)\s+fig(?:ure)?\.?|table|图|表)\s*[A-Za-z0-9]", text)
        and 8 <= len(words) <= 1200 and sum(map(str.isalnum, solid)) >= 0.52 * len(solid)
    )
    mine, left, right = compact(text), compact(before), compact(after)
    if gap.strip() or not whole or len(mine) < 32 or mine in compact(article) or left in mine or right in mine:
        return None
    return text
