"""The plain version of the chunker, line by line.

Null and empty pages give nothing; a document without any chunk is packed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

# fixed values: sizes in characters, patterns of headings, table rows and model cards
TARGET, OVERLAP, LEAST, LEAST_TITLED, LEAST_PAGE, DEPTH = 1400, 200, 120, 30, 20, 3
HEADING = re.compile("|".join((r"#{1,6}\s+.+", r"\d+(?:\.\d+)*\.?\s+[А-ЯЁA-Z][^\n]{2,80}", r"[А-ЯЁA-Z][А-ЯЁA-Z0-9 \-«»\"'()/,.]{4,80}")))
ROW = re.compile(r"[^|\n]{0,80}(?:\|[^|\n]{0,80})+")
CARD = re.compile(r"[A-ZА-ЯЁ][\w\-«».]{0,30}\s?\d+(?:[.,]\d+)?(?:[/\-x×]\d+(?:[.,]\d+)?)+")

Block = tuple[str | None, str, bool]


def is_heading(line: str) -> bool:
    line = line.strip()
    if not 3 < len(line) < 100 or (line[-1] in ".,;" and line[0] != "#"):
        return False
    return HEADING.fullmatch(line) is not None


def titled(chain: list[str]) -> str | None:
    return " › ".join(chain[-DEPTH:]) or None


def blocks(page: str, chain: list[str]) -> tuple[list[Block], list[str]]:
    """Blocks of a page and the headings in force at its end.

    A heading after text starts a new chain, one right after another goes below
    it.  Two table rows or more make a block; plain lines gather until a heading
    or the next model card.  A page of nothing but headings is one block.
    """
    found: list[Block] = []
    lines: list[str] = []
    before, spoken = list(chain), False

    def close() -> None:
        body = "\n".join(lines).strip()
        lines.clear()
        if body:
            found.append((titled(chain), body, False))

    for table, run in groupby(page.splitlines(), key=lambda x: ROW.fullmatch(x) is not None):
        if table:
            rows = list(run)
            if len(rows) > 1:
                found.append((titled(chain), "\n".join(rows), True))
            else:
                lines += rows
            continue
        for line in run:
            if is_heading(line):
                anew = spoken or bool(lines)
                close()
                chain = [*([] if anew else chain), line.strip().lstrip("#").strip()]
                spoken = False
                continue
            if lines and CARD.match(line):
                close()
            spoken = spoken or not line.isspace() and line != ""
            lines.append(line)
    close()
    if not found and page.strip():
        found.append((titled(before) or page.strip().splitlines()[0].strip(), page.strip(), False))
        chain = chain[-2:]
    return found, chain


def packed_table(body: str, target: int = TARGET) -> Iterator[str]:
    """Whole rows up to ``target`` characters, the first row above each piece."""
    head, *rows = [r for r in body.splitlines() if r.strip()] or [""]
    piece, size = [], len(head)
    for row in rows:
        if piece and size + len(row) + 1 > target:
            yield "\n".join([head, *piece])
            piece, size = [], len(head)
        piece.append(row)
        size += len(row) + 1
    if head:
        yield "\n".join([head, *piece])


def packed(body: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs up to ``target`` characters a piece; a piece begins with the end of the one before.

    A paragraph of more than twice that is packed by its lines if it has four or
    more, else cut at fixed steps.
    """
    out, piece = [], ""
    for part in filter(None, map(str.strip, re.split(r"\n\s*\n", body))):
        if len(part) > 2 * target:
            if part.count("\n") > 2:
                out += packed(part.replace("\n", "\n\n"), target, overlap)
            else:
                steps = range(0, len(part), target - overlap)
                out += [x for x in (part[k : k + target].strip() for k in steps) if x]
        elif not piece:
            piece = part
        elif len(piece) + len(part) + 2 <= target:
            piece += "\n\n" + part
        else:
            out.append(piece)
            piece = f"{piece[-overlap:]}\n{part}".strip() if overlap else part
    return [*out, piece] if piece else out


def chunks(pages: list[str | None]) -> list[dict]:
    """All chunks of a document whose pages are in canonical form."""
    out: list[dict] = []

    def add(heading: str | None, pieces, least: int, page: int | None) -> None:
        out.extend(
            {"ord": n, "heading": heading, "text": x, "page": page} for n, x in enumerate((x for x in pieces if len(x) >= least), len(out))
        )

    chain: list[str] = []
    for number, page in enumerate(pages, 1):
        if page is None or len(page) < LEAST_PAGE:
            continue
        found, chain = blocks(page, chain)
        for heading, body, table in found:
            add(heading, packed_table(body) if table else packed(body), LEAST_TITLED if heading else LEAST, number)
    if not out:
        add(None, packed("\n\n".join(p or "" for p in pages).strip()), LEAST, None)
    return out
