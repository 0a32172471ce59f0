"""Files of a folder as rows: scan, classes, text by format, members of archives.

The scan is Spark's ``binaryFile`` source: names and sizes are listed without
content, and content is read only for the files that a class lets through.
Formats are parsed by the standard library in Arrow batches; a file that cannot
be read gives a row with an ``error``, never a failed task.  One file's content
and text must fit into a task's memory (``MOST_BYTES`` bounds it).
"""

from __future__ import annotations

import csv
import email
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from email import policy
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.arrow import decoded

# fixed values: classes by extension, limits, field names
TEXT = (
    "pdf docx doc pptx csv tsv txt md html htm mhtml mht svg stp step igs iges dxf json xml rtf odt ods odp ott eml epub fb2 ics vsdx "
    "yaml yml ini cfg conf log sql url webloc djvu djv msg"
).split()
TABLE = "xlsx xlsm xls".split()
ARCHIVE = "zip rar 7z".split()
ASSET = "dwg rvt jpg jpeg png gif bmp tif tiff webp heic cr2 nef arw dng mp4 mov avi mkv mp3 wav m4a ogg".split()
SKIP_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini")
SKIP_PREFIXES = ("~$", "._")
MOST_BYTES, TABLE_BYTES, DEPTH, RATIO = 200 << 20, 20 << 20, 3, 200
EPUB_PARTS, EPUB_LEAST, SHEET_ROWS = 400, 50, 5000
CALENDAR = ("SUMMARY", "DESCRIPTION", "LOCATION", "DTSTART", "DTEND", "ORGANIZER")

SCHEMA = "path string, pages array<string>, n_pages int, needs_ocr boolean, error string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind_of(path: Column, size: Column) -> Column:
    """text, table, asset, archive or skip."""
    name, ext = F.element_at(F.split(path, "/"), -1), extension(path)
    hidden = name.isin(*SKIP_NAMES)
    for p in SKIP_PREFIXES:
        hidden = hidden | name.startswith(p)
    hidden = hidden | F.exists(F.split(path, "/"), lambda x: x.endswith("_files"))
    return (
        F.when(hidden, "skip").when(ext.isin(*ARCHIVE), "archive").when((size > MOST_BYTES) & ~ext.isin("mp4", "mov", "avi", "mkv"), "skip")
        .when(ext.isin(*TABLE), F.when(size > TABLE_BYTES, "asset").otherwise("table"))
        .when(ext.isin(*TEXT), "text").when(ext.isin(*ASSET), "asset").otherwise("skip")
    )


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified, kind) of all files below ``folder`` but those to skip; ordered by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.withColumn("kind", kind_of(F.col("path"), F.col("size"))).where("kind <> 'skip'").orderBy("path")


def read(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("text", "table")) -> DataFrame:
    """(path, content) of the files of the given classes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.where(kind_of(F.col("path"), F.col("length")).isin(*kinds)).select("path", "content")


def _lines(text: str, least: int = 1) -> str:
    return "\n".join(x for x in map(str.strip, text.splitlines()) if len(x) >= least)


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _tree(raw: bytes) -> ElementTree.Element:
    return ElementTree.fromstring(raw)


def _said(node: ElementTree.Element, *names: str) -> str:
    """The text of all descendants, or of those of the given local names."""
    return "".join((x.text or "") if names else "" for x in node.iter() if _local(x.tag) in names) if names else "".join(node.itertext())


class _Visible(HTMLParser):
    """Text outside scripts and page furniture."""

    hidden = {"script", "style", "nav", "footer", "header", "noscript"}

    def __init__(self) -> None:
        super().__init__()
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs) -> None:
        self.depth += tag in self.hidden
        self.parts.append("\n" if tag in ("p", "div", "br", "tr", "li", "h1", "h2", "h3", "h4") else " ")

    def handle_endtag(self, tag) -> None:
        if tag in self.hidden and self.depth:
            self.depth -= 1
        self.parts.append(" ")

    def handle_data(self, data) -> None:
        if not self.depth:
            self.parts.append(data)


def visible(html: str) -> str:
    parser = _Visible()
    parser.feed(html)
    parser.close()
    return _lines(re.sub(r"[ \t\xa0]+", " ", "".join(parser.parts)))


def _docx(raw: bytes, ext: str) -> list[str]:
    """Paragraphs; headings marked, table rows by cells."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = _tree(z.read("word/document.xml"))
    out: list[str] = []

    def paragraph(p) -> str:
        return "".join("\t" if _local(x.tag) == "tab" else (x.text or "") for x in p.iter() if _local(x.tag) in ("t", "tab")).strip()

    def walk(node) -> None:
        for x in node:
            name = _local(x.tag)
            if name == "p":
                text = paragraph(x)
                style = next((v.lower() for y in x.iter() if _local(y.tag) == "pStyle" for v in y.attrib.values()), "")
                if text:
                    out.append(f"\n## {text}\n" if style.startswith(("heading", "заголов")) else text)
            elif name == "tbl":
                rows = [[" ".join(_said(p, "t") for p in c.iter() if _local(p.tag) == "p").strip() for c in r if _local(c.tag) == "tc"] for r in x.iter() if _local(r.tag) == "tr"]
                out.append("\n" + "\n".join(" | ".join(r) for r in rows if any(r)) + "\n")
            else:
                walk(x)

    walk(body)
    return ["\n".join(out)]


def _members(z: zipfile.ZipFile, begin: str, end: str) -> list[str]:
    """Members in the order of the numbers in their names."""
    names = [n for n in z.namelist() if n.startswith(begin) and n.endswith(end)]
    return sorted(names, key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])


def _pptx(raw: bytes, ext: str) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = [_tree(z.read(n)) for n in _members(z, "ppt/slides/slide", ".xml")]
    return [_lines("\n".join(x.text or "" for x in s.iter() if _local(x.tag) == "t")) for s in slides]


def sheets(raw: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of cells as text) of a workbook's sheets."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = [_said(x, "t") for x in _tree(z.read("xl/sharedStrings.xml")) if _local(x.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        titles = [x.attrib["name"] for x in _tree(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
        out = []
        for title, member in zip(titles, _members(z, "xl/worksheets/sheet", ".xml")):
            rows = []
            for r in (x for x in _tree(z.read(member)).iter() if _local(x.tag) == "row"):
                cells: dict[int, str] = {}
                for c in r:
                    letters = re.match(r"[A-Z]+", c.attrib.get("r", ""))
                    place = len(cells)
                    if letters:
                        place = 0
                        for letter in letters[0]:
                            place = place * 26 + ord(letter) - 64
                        place -= 1
                    value = _said(c, "v", "t")
                    cells[place] = shared[int(value)] if c.attrib.get("t") == "s" and value else value
                rows.append([cells.get(k, "").strip() for k in range(max(cells, default=-1) + 1)])
            out.append((title, rows))
    return out


def _xlsx(raw: bytes, ext: str) -> list[str]:
    pages = []
    for title, rows in sheets(raw):
        lines = [x for x in (" | ".join(c for c in r if c) for r in rows[:SHEET_ROWS]) if x]
        if len(rows) > SHEET_ROWS:  # the format's own bound, said in the text
            lines.append(f"... (усечено, всего строк: {len(rows)})")
        if lines:
            pages.append("\n".join([f"# Лист: {title}", *lines]))
    return pages


def _csv(raw: bytes, ext: str) -> list[str]:
    text = decoded(raw.removeprefix(b"\xef\xbb\xbf"))
    try:
        dialect = csv.Sniffer().sniff(text[:4000], delimiters=";,\t")  # only the delimiter is told from the beginning
    except csv.Error:
        return ["\n".join(text.splitlines())]
    return ["\n".join(" | ".join(r) for r in csv.reader(io.StringIO(text), dialect))]


def _plain(raw: bytes, ext: str) -> list[str]:
    return [decoded(raw)]


def _html(raw: bytes, ext: str) -> list[str]:
    return [visible(decoded(raw))]


def _payload(part) -> str:
    return (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "replace")


def _mhtml(raw: bytes, ext: str) -> list[str]:
    for part in email.message_from_bytes(raw).walk():
        if part.get_content_type() == "text/html":
            return [visible(_payload(part))]
    raise ValueError("no HTML part")


def _mail(raw: bytes, ext: str) -> list[str]:
    """Head lines, the plain body (else the HTML one) and the names of attachments."""
    mail = email.message_from_bytes(raw, policy=policy.default)
    head = [f"{said}: {mail.get(field, '')}" for said, field in (("От", "From"), ("Кому", "To"), ("Дата", "Date"), ("Тема", "Subject"))]
    body = mail.get_body(("plain",)) or mail.get_body(("html",))
    text = "" if body is None else _payload(body) if body.get_content_type() == "text/plain" else visible(_payload(body))
    files = [x.get_filename() for x in mail.iter_attachments() if x.get_filename()]
    return ["\n".join([*head, "", text.rstrip("\n"), *(["", "Вложения: " + "; ".join(files)] if files else [])])]


_RTF = re.compile(rb"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)")
_RTF_UNSEEN = {b"fonttbl", b"colortbl", b"stylesheet", b"info", b"pict", b"header", b"footer"}


def _rtf(raw: bytes, ext: str) -> list[str]:
    """Text of the groups that show, bytes as cp1251."""
    out, stack, unseen = [], [], False
    for code, word, number, sign, brace, plain in _RTF.findall(raw):
        if brace == b"{":
            stack.append(unseen)
        elif brace == b"}":
            unseen = stack.pop() if stack else False
        elif sign == b"*" or word in _RTF_UNSEEN:
            unseen = True
        elif unseen:
            continue
        elif code:
            out.append(bytes([int(code, 16)]).decode("cp1251", "replace"))
        elif word in (b"par", b"line", b"row"):
            out.append("\n")
        elif word in (b"tab", b"cell"):
            out.append("\t")
        elif word == b"u" and number:
            out.append(chr(int(number) % 65536))
        elif plain:
            out.append(plain.decode("cp1251", "replace"))
        elif sign in (b"\\", b"{", b"}"):
            out.append(sign.decode())
    text = _lines(re.sub(r"[ \t]{2,}", " ", "".join(out)))
    if not text:
        raise ValueError("empty")
    return [text]


def _odf(raw: bytes, ext: str) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        tree = _tree(z.read("content.xml"))
    out: list[str] = []

    def walk(node, cell: bool) -> None:
        name = _local(node.tag)
        if node.text:
            out.append(node.text)
        for x in node:
            walk(x, cell or name == "table-cell")
            if x.tail:
                out.append(x.tail)
        if name == "table-cell":
            out.append(" | ")
        elif name == "table-row" or (name in ("p", "h") and not cell):
            out.append("\n")

    walk(tree, False)
    return [_lines("".join(out))]


def _epub(raw: bytes, ext: str) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        parts = sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))[:EPUB_PARTS]
        texts = [" ".join(visible(z.read(n).decode("utf-8", "replace")).split()) for n in parts]
    return [x for x in texts if len(x) > EPUB_LEAST]


def _fb2(raw: bytes, ext: str) -> list[str]:
    out = []
    for event, node in ElementTree.iterparse(io.BytesIO(raw), events=("end",)):
        if _local(node.tag) == "binary":
            node.clear()
        elif _local(node.tag) in ("p", "v", "subtitle", "text-author", "book-title"):
            out.append("".join(node.itertext()))
    return [_lines("\n".join(out), 3)]


def _calendar(raw: bytes, ext: str) -> list[str]:
    return ["\n".join(x for x in decoded(raw).splitlines() if re.split("[:;]", x, maxsplit=1)[0] in CALENDAR)]


def _visio(raw: bytes, ext: str) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        trees = [_tree(z.read(n)) for n in _members(z, "visio/pages/", ".xml")]
    pages = [_lines("\n".join("".join(x.itertext()) for x in t.iter() if _local(x.tag) == "Text")) for t in trees]
    return [p for p in pages if p]


def _svg(raw: bytes, ext: str) -> list[str]:
    text = _lines("\n".join(" ".join(x.itertext()) for x in _tree(raw).iter() if _local(x.tag) in ("text", "title", "desc")))
    return [text] if text else []


def _step(raw: bytes, ext: str) -> list[str]:
    """The header's file name and the products' names; of IGES the start section."""
    text = raw.decode("utf-8", "ignore")
    head = re.search(r"FILE_NAME\s*\((.*?)\);", text, re.S | re.I)
    out = ["Заголовок STEP: " + " ".join(head[1].split())[:600]] if head else []
    out += [f"Изделие: {x}" for x in dict.fromkeys(re.findall(r"PRODUCT\s*\(\s*'([^']{2,80})'", text, re.I))]
    if not out and ext in ("igs", "iges"):
        out = [x[:72].strip() for x in text.splitlines() if x[72:73] == "S"]
    return ["\n".join(dict.fromkeys(out))] if out else []


def _dxf(raw: bytes, ext: str) -> list[str]:
    """Different values of the text groups (codes 1, 2 and 3), in order."""
    lines = [x.strip() for x in decoded(raw).splitlines()]
    texts = (v for c, v in zip(lines[::2], lines[1::2]) if c in ("1", "2", "3"))
    kept = dict.fromkeys(v for v in texts if 2 < len(v) < 200 and not v.startswith(("AcDb", "{\\f", "*")))
    return ["\n".join(kept)] if kept else []


def _pdf(raw: bytes, ext: str) -> list[str]:
    try:
        import fitz
    except ImportError as e:
        raise ValueError("no PDF library here") from e
    with fitz.open(stream=raw, filetype="pdf") as doc:
        return [p.get_text() for p in doc]


PARSERS: dict[str, Callable[[bytes, str], list[str]]] = {
    "docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "xlsm": _xlsx, "csv": _csv, "tsv": _csv, "html": _html, "htm": _html, "mhtml": _mhtml, "mht": _mhtml,
    "eml": _mail, "rtf": _rtf, "odt": _odf, "ods": _odf, "odp": _odf, "ott": _odf, "epub": _epub, "fb2": _fb2, "ics": _calendar, "vsdx": _visio,
    "svg": _svg, "stp": _step, "step": _step, "igs": _step, "iges": _step, "dxf": _dxf, "pdf": _pdf,
} | dict.fromkeys("txt md json xml yaml yml ini cfg conf log sql url webloc".split(), _plain)


def extract(path: str, raw: bytes) -> tuple[list[str], bool, str | None]:
    """(pages, needs_ocr, error) of a file's content."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    parse = PARSERS.get(ext)
    if parse is None:
        return [], False, f"no parser for .{ext}"
    try:
        pages = parse(raw, ext)
    except Exception as e:  # whatever a broken file raises is its row's error
        return [], False, f"{ext}: {type(e).__name__}: {e}"
    return pages, not pages or (ext == "pdf" and sum(map(len, pages)) < 100 * len(pages)), None


def extracted(files: DataFrame) -> DataFrame:
    """``SCHEMA`` rows of files (path, content); null content is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(*(c.to_pylist() for c in batch.columns)):
                pages, ocr, error = extract(path or "", raw) if raw is not None else ([], False, "no content")
                row = [[path], [pages], [len(pages)], [ocr], [error]]
                kinds = (pa.string(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["path", "pages", "n_pages", "needs_ocr", "error"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def members(path: str, raw: bytes, depth: int = 0) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path, content, error) of an archive's files, archives in it included, to ``DEPTH``; none of an archive that swells beyond ``RATIO``."""
    if depth > DEPTH:
        yield path, None, "archives nested too deep"
        return
    if not path.lower().endswith(".zip"):
        yield path, None, "no unpacker for this format"
        return
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            infos = [x for x in z.infolist() if not x.is_dir()]
            if raw and sum(x.file_size for x in infos) / len(raw) > RATIO:
                yield path, None, "suspicious compression"
                return
            for x in infos:
                inner, content = f"{path}/{x.filename}", z.read(x)
                if inner.rsplit(".", 1)[-1].lower() in ARCHIVE:
                    yield from members(inner, content, depth + 1)
                else:
                    yield inner, content, None
    except (zipfile.BadZipFile, RuntimeError, OSError) as e:
        yield path, None, f"{type(e).__name__}: {e}"


def unpacked(archives: DataFrame) -> DataFrame:
    """(path, content, error) of the files in archives (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(*(c.to_pylist() for c in batch.columns)):
                for inner, content, error in members(path, raw or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([inner]), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "error"])

    return archives.select("path", "content").mapInArrow(run, "path string, content binary, error string")
