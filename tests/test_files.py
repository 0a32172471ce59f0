"""Scan, formats and workbooks on files made here."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from granary.sources import files as fl
from granary.sources import prices as pr

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def workbook(rows, title="Прайс"):
    strings, body = [], []
    for n, row in enumerate(rows, 1):
        cells = []
        for k, value in enumerate(row):
            if value is None:
                continue
            if isinstance(value, str):
                strings.append(value)
                cells.append(f'<c r="{chr(65 + k)}{n}" t="s"><v>{len(strings) - 1}</v></c>')
            else:
                cells.append(f'<c r="{chr(65 + k)}{n}"><v>{value}</v></c>')
        body.append(f'<row r="{n}">{"".join(cells)}</row>')
    shared = "".join(f"<si><t>{x}</t></si>" for x in strings)
    return zipped(**{
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="{title}" sheetId="1"/></sheets></workbook>',
        "xl/sharedStrings.xml": f"<sst {S}>{shared}</sst>", "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{''.join(body)}</sheetData></worksheet>",
    })


PRICES = workbook([
    ["Прайс-лист 2024"], ["Артикул", "Наименование", "Цена, руб", "Ед.", "Масса"], [None, "Насосы"], ["500036", "Насос Водомёт ПРОФ 55/75", "18 400,00", "шт", "12"],
    ["500037", "Насос Водомёт ПРОФ 60/92", 21900, "шт", None], [None, "Просто описание без цены"], [None, "x" * 300, 5],
])

CASES = {
    "a.txt": ("Привет".encode("cp1251"), ["Привет"]),
    "a.docx": (zipped(**{"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Глава</w:t></w:r></w:p><w:p><w:r><w:t>Текст </w:t></w:r><w:r><w:t>дальше</w:t></w:r></w:p>'
        '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Напор</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>75</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'}), ["\n## Глава\n\nТекст дальше\n\nНапор | 75\n"]),
    "a.pptx": (zipped(**{f"ppt/slides/slide{k}.xml": f'<p xmlns:a="urn:a"><a:t>Slide {k}</a:t><a:t> two </a:t></p>' for k in (10, 2)}), ["Slide 2\ntwo", "Slide 10\ntwo"]),
    "a.xlsx": (workbook([["Модель", "Напор"], [None, None], ["55/75", 75]]), ["# Лист: Прайс\nМодель | Напор\n55/75 | 75"]),
    "a.csv": ("модель;напор\n55/75;75\n".encode("cp1251"), ["модель | напор\n55/75 | 75"]),
    "a.html": (b"<html><script>x</script><nav>menu</nav><p>One &amp; two</p><p>three</p></html>", ["One & two\nthree"]),
    "a.eml": (b"From: a@b.c\nTo: d@e.f\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nSubject: Hi\nContent-Type: text/plain\n\nBody here\n", ["От: a@b.c\nКому: d@e.f\nДата: Mon, 01 Jan 2024 00:00:00 +0000\nТема: Hi\n\nBody here"]),
    "a.mhtml": (b'MIME-Version: 1.0\nContent-Type: multipart/related; boundary="b"\n\n--b\nContent-Type: text/html; charset=utf-8\n\n<p>Saved page</p>\n--b--\n', ["Saved page"]),
    "a.rtf": (rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\'cf\'f0\'e8\'e2\'e5\'f2\par next \{x\}}", ["Привет\nnext {x}"]),
    "a.odt": (zipped(**{"content.xml": '<o xmlns:text="t" xmlns:table="b"><text:h>Head</text:h><text:p>Para</text:p><table:table-row><table:table-cell><text:p>a</text:p></table:table-cell><table:table-cell><text:p>b</text:p></table:table-cell></table:table-row></o>'}), ["Head\nPara\na | b |"]),
    "a.epub": (zipped(**{"b.xhtml": "<p>" + "long enough " * 6 + "</p>", "a.xhtml": "<p>short</p>"}), [("long enough " * 6).strip()]),
    "a.fb2": ("<f><body><p>Первый абзац</p><p>a</p></body><binary>AAAA</binary></f>".encode(), ["Первый абзац"]),
    "a.ics": (b"BEGIN:VEVENT\nSUMMARY:Meet\nDTSTART;TZID=x:2024\nUID:1\n", ["SUMMARY:Meet\nDTSTART;TZID=x:2024"]),
    "a.vsdx": (zipped(**{"visio/pages/page1.xml": "<P><Text>Pump <b>1</b></Text><Text> </Text></P>"}), ["Pump 1"]),
    "a.svg": (b'<svg xmlns="http://www.w3.org/2000/svg"><title>Scheme</title><text>P1</text></svg>', ["Scheme\nP1"]),
    "a.step": (b"ISO;\nFILE_NAME('x.stp',\n '2024');\n#1=PRODUCT('Pump 55','');#2=PRODUCT('Pump 55','');", ["Заголовок STEP: 'x.stp', '2024'\nИзделие: Pump 55"]),
    "a.dxf": (b"0\nTEXT\n1\nMass 12 kg\n2\nAcDbX\n3\nMass 12 kg\n8\nlayer\n", ["Mass 12 kg"]),
}


@pytest.mark.parametrize("name", CASES)
def test_format(name):
    raw, pages = CASES[name]
    assert fl.extract(name, raw) == (pages, False, None)


def test_broken_and_unknown_files():
    for name in CASES:
        pages, _, error = fl.extract(name, b"")
        assert isinstance(pages, list) and (error is None or error)
    assert fl.extract("a.docx", b"no zip")[2].startswith("docx: BadZipFile")
    assert fl.extract("a.xyz", b"")[2] == "no parser for .xyz"
    assert fl.extract("a.svg", b"<svg/>") == ([], True, None)


def test_folder(spark, tmp_path):
    inner = zipped(**{"d.txt": "deep"})
    put = {"b/a.txt": b"one", "a/c.xlsx": PRICES, "a/~$c.xlsx": b"", "a/x_files/y.html": b"", "a/p.dwg": b"1", "a/q.bin": b"1", "z.zip": zipped(**{"m/a.txt": "in", "n.zip": inner})}
    for name, raw in put.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    root = f"file:{tmp_path}/"
    seen = [(r["path"].removeprefix(root), r["kind"]) for r in fl.scan(spark, str(tmp_path)).collect()]
    assert seen == [("a/c.xlsx", "table"), ("a/p.dwg", "asset"), ("b/a.txt", "text"), ("z.zip", "archive")]
    texts = {r["path"].removeprefix(root): r["pages"] for r in fl.extracted(fl.read(spark, str(tmp_path))).collect()}
    assert texts["b/a.txt"] == ["one"] and len(texts) == 2
    found = fl.unpacked(fl.read(spark, str(tmp_path), ("archive",)))
    assert sorted((r["path"].removeprefix(root), bytes(r["content"])) for r in found.collect()) == [("z.zip/m/a.txt", b"in"), ("z.zip/n.zip/d.txt", b"deep")]
    rows = [tuple(r) for r in pr.price_rows(fl.read(spark, str(tmp_path), ("table",))).select("article", "name", "price", "unit", "attrs").collect()]
    assert rows == [("500036", "Насос Водомёт ПРОФ 55/75", 18400.0, "шт", {"Масса": "12"}), ("500037", "Насос Водомёт ПРОФ 60/92", 21900.0, "шт", {})]
    assert fl.scan(spark, str(tmp_path)).where(F.col("size") > 10).count() >= 2


def test_archives_that_swell_or_nest():
    bomb = zipped(**{"a.txt": "0" * 3_000_000})
    assert [x[2] for x in fl.members("a.zip", bomb)] == ["suspicious compression"]
    raw = b"x"
    for k in range(6):
        raw = zipped(**{("a.txt" if k == 0 else f"n{k}.zip"): raw})
    assert [x[2] for x in fl.members("a.zip", raw)] == ["archives nested too deep"]
    assert [x[2] for x in fl.members("a.rar", b"")] == ["no unpacker for this format"]
