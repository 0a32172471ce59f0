"""Product rows of price workbooks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from granary.sources.files import sheets

# fixed values: how headings of columns begin or what they hold, rows looked through for a header, longest name
ARTICLE = ("артикул", "арт.", "арт", "код товара", "код", "article", "sku")
NAME = ("наименование", "название", "номенклатура", "товар", "модель", "name")
PRICE = ("цена", "стоимость", "розниц", "price")
UNIT = ("ед.", "ед", "ед. изм.", "ед.изм.", "единица", "unit")
HEADER_ROWS, LONGEST_NAME = 30, 250
FIELDS = "path string, sheet string, article string, name string, price double, unit string, attrs map<string,string>"


def price_of(cell: str) -> float | None:
    """A positive number; blanks and currency go, the comma is a dot."""
    digits = re.sub(r"[^\d.]", "", cell.replace(",", "."))
    if not digits.strip(".") or digits.count(".") > 1:
        return None
    return float(digits) or None


def role(cell: str, taken: dict[str, int]) -> str | None:
    """What a column with this heading holds, of what is still looked for."""
    tests = {
        "article": lambda h: cell.startswith(ARTICLE),
        "name": lambda h: any(x in cell for x in NAME),
        "price": lambda h: any(x in cell for x in PRICE),
        "unit": lambda h: cell in UNIT,
    }
    return next((k for k, test in tests.items() if k not in taken and test(cell)), None) if cell else None


def header(rows: list[list[str]]) -> tuple[int, dict[str, int]] | None:
    """(row, column of each role): of the first rows the one that names most, a price counting twice; a name is a must."""
    best, score = None, 1
    for n, row in enumerate(rows[:HEADER_ROWS]):
        roles: dict[str, int] = {}
        for k, cell in enumerate(row):
            found = role(" ".join(cell.lower().split()), roles)
            if found:
                roles[found] = k
        own = len(roles) + ("price" in roles)
        if "name" in roles and own > score:
            best, score = (n, roles), own
    return best


def products(raw: bytes) -> Iterator[dict]:
    """Rows with a name or an article, and with a price or an article."""
    for sheet, rows in sheets(raw):
        found = header(rows)
        if found is None:
            continue
        top, roles = found
        others = {k: x for k, x in enumerate(rows[top]) if x and k not in roles.values()}
        for row in rows[top + 1 :]:
            cell = lambda what: row[roles[what]] if roles.get(what, len(row)) < len(row) else ""  # noqa: B023, E731
            article = cell("article") if re.fullmatch(r"[\w\-./№]{1,24}", cell("article")) else ""
            name, price = cell("name"), price_of(cell("price"))
            if (name or article) and (article or price is not None) and len(name) <= LONGEST_NAME:
                attrs = [(title, row[k]) for k, title in others.items() if k < len(row) and row[k]]
                yield {"sheet": sheet, "article": article, "name": name, "price": price, "unit": cell("unit"), "attrs": attrs}


def price_rows(files: DataFrame) -> DataFrame:
    """``FIELDS`` rows of workbooks (path, content); a file that is no workbook gives none."""
    fields = ("sheet", "article", "name", "price", "unit", "attrs")
    kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.map_(pa.string(), pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows = list(products(raw or b""))
                except Exception:  # a broken workbook has no products; ``files.extracted`` reports its error
                    rows = []
                columns = [pa.array([path] * len(rows), pa.string())] + [pa.array([r[f] for r in rows], k) for f, k in zip(fields, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", *fields])

    return files.select("path", "content").mapInArrow(run, FIELDS)
