"""Cutting one Markdown text into chunks: plain Python on one document, called in batches by operators.chunk."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

from ..params import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS

# A table is a row, a separator row and more rows, each with its line end; a heading has 1-4 marks.
TABLE = re.compile(r"\|[^\n]+\|\n\|[-| :]+\|\n(?:\|[^\n]+\|\n)*")
HEADING = re.compile(r"^#{1,4}\s+(.+)", re.MULTILINE)


def segment_markdown(text: str) -> list[tuple[bool, str]]:
    """(is_table, text) in order; together they are the whole text."""
    out, at = [], 0
    for m in TABLE.finditer(text):
        out += [(False, text[at : m.start()])] * (m.start() > at) + [(True, m.group())]
        at = m.end()
    return out + [(False, text[at:])] * (at < len(text))


def char_windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` characters; blank ones are left out."""
    cuts = range(0, len(text), max(1, size - overlap))
    return [w for i in cuts if (w := text[i : i + size]).strip()]


def _pack(pieces: list[str], joiner: str, size: int, overlap: int) -> Iterator[str]:
    """Joins neighbouring pieces up to ``size``; a new window starts with what fits of the old one's end in ``overlap``.

    What is carried over is not counted against ``size`` again, so a window may be too long; it is then cut by characters.
    """
    window: deque[str] = deque()
    letters = 0  # of the window's pieces, without joiners

    def length() -> int:
        return letters + len(joiner) * max(0, len(window) - 1)

    def emit() -> list[str]:
        whole = joiner.join(window)
        return ([whole] if len(whole) <= size else char_windows(whole, size, overlap)) if window else []

    for piece in pieces:
        if window and length() + len(joiner) + len(piece) > size:
            yield from emit()
            while window and length() > overlap:
                letters -= len(window.popleft())
        window.append(piece)
        letters += len(piece)
    yield from emit()


def recursive_split(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: list[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters: by the first separator that occurs, longer pieces by the later ones."""
    bare = text.strip()
    if len(text) <= size or not bare:
        return [bare] if bare else []
    rank = next((k for k, s in enumerate(separators) if s in text), None)
    if rank is None:
        return [bare]
    by, later = separators[rank], separators[rank + 1 :]
    if not by:
        return [w.strip() for w in char_windows(text, size, overlap)]
    pieces: list[str] = []
    for part in filter(None, map(str.strip, text.split(by))):
        pieces += [part] if len(part) <= size else recursive_split(part, size, overlap, later)
    return [c for w in _pack(pieces, by.strip() or " ", size, overlap) if (c := w.strip())]


def table_columns(table: str) -> list[str]:
    first = table.strip().splitlines()[0]
    return [c for x in first.split("|") if (c := x.strip())]


def split_table(table: str, size: int = CHUNK_SIZE) -> list[str]:
    """A table that fits is one chunk; else rows are packed under the repeated head. A long row stays whole."""
    if len(table) <= size:
        return [table.strip()]
    head, rows = (lines := table.strip().splitlines())[:2], lines[2:]
    out: list[list[str]] = []
    used = 0
    for row in rows:
        if not out or used + len(row) + 1 > size:
            # the first row opens a chunk whether it fits or not
            out.append([])
            used = sum(map(len, head)) + 2
        out[-1].append(row)
        used += len(row) + 1
    return ["\n".join(head + group).strip() for group in out]


def chunk_text(text: str) -> Iterator[tuple[str, bool, list[str], str]]:
    """(text, is_table, columns, heading) of each chunk in order."""
    heading = "Introduction"

    def last_heading(part: str, before: str) -> str:
        return ([before] + [m.strip() for m in HEADING.findall(part)])[-1]

    for is_table, part in segment_markdown(text):
        if is_table:
            columns = table_columns(part)
            yield from ((c, True, columns, heading) for c in split_table(part))
            continue
        heading = last_heading(part, heading)
        for chunk in recursive_split(part):
            heading = last_heading(chunk, heading)
            yield chunk, False, [], heading
