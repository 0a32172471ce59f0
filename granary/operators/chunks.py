"""Cutting documents into chunks by headings, tables, model cards and paragraphs.

A document is an array of pages.  Its lines are rows: runs of table rows, headings,
model cards and the chain of headings in force (which runs on from page to page)
are windows over a document's lines; blocks are put together by number, and each
block is packed into pieces by folds over its own rows or paragraphs.

Null and short pages give nothing; a document without any chunk is packed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators.tables import written

# fixed values: sizes in characters, patterns of headings, table rows and model cards
TARGET, OVERLAP, LEAST, LEAST_TITLED, LEAST_PAGE, DEPTH = 1400, 200, 120, 30, 20, 3
HEADING = (
    r"(?U)\A(?:#{1,6}\s+.+"
    r"|\d+(?:\.\d+)*\.?\s+[А-ЯЁA-Z][^\n]{2,80}"
    r"|[А-ЯЁA-Z][А-ЯЁA-Z0-9 \-«»\"'()/,.]{4,80})\z"
)
ROW = r"\A[^|\n]{0,80}(?:\|[^|\n]{0,80})+\z"
CARD = r"(?U)\A[A-ZА-ЯЁ][\w\-«».]{0,30}\s?\d+(?:[.,]\d+)?(?:[/\-x×]\d+(?:[.,]\d+)?)+"
_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


#: all white space
_WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_WHITE))


def _with(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, _stripped), lambda x: x != "")


def is_heading(line: Column) -> Column:
    def told(own: Column) -> Column:
        sentence = F.right(own, F.lit(1)).isin(".", ",", ";") & (F.left(own, F.lit(1)) != "#")
        return F.length(own).between(4, 99) & ~sentence & own.rlike(HEADING)

    return _with(_stripped(line), told)


def packed_table(body: Column, target: int = TARGET) -> Column:
    """Whole rows up to ``target`` characters, the first row above each piece."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("piece"), F.lit(0).alias("size"))

    def pieces(table: Column) -> Column:
        head = table["head"]

        def step(held: Column, row: Column) -> Column:
            full = (held["piece"] != "") & (F.length(head) + held["size"] + F.length(row) + 1 > target)
            more = F.concat(F.lit("\n"), row)
            return F.struct(
                F.when(full, F.concat(held["out"], F.array(F.concat(head, held["piece"])))).otherwise(held["out"]).alias("out"),
                F.when(full, more).otherwise(F.concat(held["piece"], more)).alias("piece"),
                (F.when(full, 0).otherwise(held["size"]) + F.length(row) + 1).alias("size"),
            )

        last = lambda held: F.when(head != "", F.concat(held["out"], F.array(F.concat(head, held["piece"])))).otherwise(held["out"])
        return F.aggregate(table["rows"], start, step, last)

    rows = F.filter(F.split(body, "\n"), lambda x: _stripped(x) != "")
    return _with(rows, lambda r: _with(F.struct(F.coalesce(F.get(r, F.lit(0)), F.lit("")).alias("head"), F.slice(r, 2, 1 << 30).alias("rows")), pieces))


def _steps(part: Column, target: int, overlap: int) -> Column:
    """A long text cut at fixed steps."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(part) - 1, F.lit(0)), F.lit(target - overlap))
    return _filled(F.transform(starts, lambda k: F.substring(part, k + 1, F.lit(target))))


def _fold(parts: Column, target: int, overlap: int, cut) -> Column:
    """Parts gathered up to ``target``; a part of more than twice that gives the pieces of ``cut`` and joins nothing."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("piece"))
    sized = F.transform(parts, lambda p: F.struct(p.alias("p"), F.when(F.length(p) > 2 * target, cut(p)).alias("pieces")))

    def step(held: Column, x: Column) -> Column:
        long, empty = x["pieces"].isNotNull(), held["piece"] == ""
        fits = F.length(held["piece"]) + F.length(x["p"]) + 2 <= target
        anew = _stripped(F.concat(F.right(held["piece"], F.lit(overlap)), F.lit("\n"), x["p"])) if overlap else x["p"]
        out = F.when(long, F.concat(held["out"], x["pieces"])).when(empty | fits, held["out"]).otherwise(F.concat(held["out"], F.array(held["piece"])))
        piece = F.when(long, held["piece"]).when(empty, x["p"]).when(fits, F.concat(held["piece"], F.lit("\n\n"), x["p"])).otherwise(anew)
        return F.struct(out.alias("out"), piece.alias("piece"))

    return F.aggregate(sized, start, step, lambda held: F.when(held["piece"] != "", F.concat(held["out"], F.array(held["piece"]))).otherwise(held["out"]))


def packed(body: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Paragraphs up to ``target`` characters a piece; a piece begins with the end of the one before.

    A paragraph of more than twice that is packed by its lines if it has four or
    more, else cut at fixed steps.
    """
    plain = lambda p: _steps(p, target, overlap)
    newlines = lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))
    by_lines = lambda p: _fold(_filled(F.split(p, "\n")), target, overlap, plain)
    return _fold(_filled(F.split(body, r"(?U)\n\s*\n")), target, overlap, lambda p: F.when(newlines(p) > 2, by_lines(p)).otherwise(plain(p)))


def page_blocks(pages: DataFrame, key: str) -> DataFrame:
    """(key, page, n, heading, body, is_table) of pages (key, page, text), texts in canonical form.

    A heading after text starts a new chain, one right after another goes below
    it.  Two table rows or more make a block; plain lines gather until a heading
    or the next model card, over tables between them.  A page of nothing but headings is one block.
    Blocks are numbered from 0 in the order in which they end (tables: begin).
    """
    # dealt by document once, whole texts: every window below finds its rows together
    lines = pages.repartition(key).select(key, "page", F.posexplode(F.split("text", _BREAK)).alias("i", "line"))
    page = Window.partitionBy(key, "page").orderBy("i")
    doc = Window.partitionBy(key).orderBy("page", "i")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c, w: F.sum(F.when(c, 1).otherwise(0)).over(w)
    row = F.col("row")
    x = lines.withColumn("row", F.col("line").rlike(ROW)).withColumn("filled", _stripped(F.col("line")) != "")
    x = x.withColumn("turn", F.coalesce(row != F.lag("row").over(page), F.lit(True)))
    x = x.withColumn("run", count(F.col("turn"), page)).withColumn("table", row & (F.count(F.lit(1)).over(Window.partitionBy(key, "page", "run")) > 1))
    x = x.withColumn("head", ~row & is_heading(F.col("line"))).withColumn("plain", ~F.col("table") & ~F.col("head"))
    x = x.withColumn("ends", F.col("head") | (~row & F.col("line").rlike(CARD))).withColumn("block", count(F.col("ends"), page))
    # a heading starts a new chain if a plain line stands between the one before it and itself
    x = x.withColumn("so_far", F.coalesce(count(F.col("plain"), ahead(page)), F.lit(0)))
    since = F.coalesce(F.last(F.when(F.col("head"), F.col("so_far")), ignorenulls=True).over(ahead(page)), F.lit(0))
    x = x.withColumn("anew", F.col("head") & (F.col("so_far") > since)).withColumn("chain", count(F.col("anew"), doc))
    only = ~F.bool_or(F.col("table") | (F.col("plain") & F.col("filled"))).over(Window.partitionBy(key, "page"))
    name = _stripped(F.ltrim(_stripped(F.col("line")), F.lit("#")))
    x = x.withColumn("only", only).withColumn("own", F.when(F.col("head"), F.struct("chain", name.alias("name"))))
    x = x.withColumn("one", F.last("own", ignorenulls=True).over(ahead(doc)))
    x = x.withColumn("two", F.last(F.when(F.col("head"), F.col("one")), ignorenulls=True).over(ahead(doc)))
    same = lambda c: F.when(F.col(c)["chain"] == F.col("chain"), F.col(c)["name"])
    names = F.filter(F.array(same("two"), same("one"), F.col("own")["name"]), lambda s: s.isNotNull())
    x = x.withColumn("set", F.when(F.col("head"), F.struct(names.alias("names"), "page", "only")))

    def title(held: Column) -> Column:
        """Of a page of nothing but headings, later pages keep the last two."""
        cut = held["only"] & (held["page"] < F.col("page")) & (F.size(held["names"]) > DEPTH - 1)
        kept = F.when(cut, F.slice(held["names"], -(DEPTH - 1), DEPTH - 1)).otherwise(held["names"])
        return F.when(F.size(kept) > 0, F.array_join(kept, " › "))

    x = x.withColumn("title", title(F.last("set", ignorenulls=True).over(doc)))
    x = x.withColumn("before", title(F.last("set", ignorenulls=True).over(ahead(doc))))
    x = x.withColumn("begin", F.first("before").over(Window.partitionBy(key, "page").orderBy("i")))
    x = written(x.select(key, "page", "i", "line", "run", "block", "table", "plain", "ends", "only", "filled", "title", "begin"))
    text = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n")
    tables = x.where("table").groupBy(key, "page", "run").agg(F.min("i").alias("at"), F.first("title").alias("heading"), text().alias("body"))
    # a plain block ends where the next begins
    plain = x.where("NOT only AND plain").groupBy(key, "page", "block").agg(F.first("title").alias("heading"), _stripped(text()).alias("body"))
    ends = x.where("ends").select(key, "page", (F.col("block") - 1).alias("block"), F.col("i").alias("at"))
    keys = [key, "page", "block"]
    plain = plain.where("body <> ''").join(ends, keys, "left").select(key, "page", F.coalesce("at", F.lit((1 << 31) - 1)).alias("at"), "heading", "body", F.lit(False).alias("is_table"))
    first_line = F.min_by(F.when(F.col("filled"), _stripped(F.col("line"))), F.when(F.col("filled"), F.col("i")))
    alone = x.where("only").groupBy(key, "page").agg(F.first("begin").alias("begin"), first_line.alias("first"), _stripped(text()).alias("body"))
    alone = alone.where("body <> ''").select(key, "page", F.lit(0).alias("at"), F.coalesce("begin", "first").alias("heading"), "body", F.lit(False).alias("is_table"))
    out = tables.select(key, "page", "at", "heading", "body", F.lit(True).alias("is_table")).unionByName(plain).unionByName(alone)
    n = F.row_number().over(Window.partitionBy(key, "page").orderBy("at")) - 1
    return out.select(key, "page", n.alias("n"), "heading", "body", "is_table")


def document_chunks(docs: DataFrame, key: str, pages: str) -> DataFrame:
    """(key, ord, heading, text, page) of every chunk of documents (key: unique; pages: array<string>)."""
    read = docs.select(key, F.posexplode(F.transform(pages, tx.chunk_text)).alias("p", "text"))
    own = read.where(F.length("text") >= LEAST_PAGE).select(key, (F.col("p") + 1).alias("page"), "text")
    blocks = page_blocks(own, key)
    pieces = F.posexplode(F.when(F.col("is_table"), packed_table(F.col("body"))).otherwise(packed(F.col("body"))))
    found = blocks.select(key, "page", "n", "heading", pieces.alias("piece", "text"))
    least = F.when(F.col("heading").isNotNull(), LEAST_TITLED).otherwise(LEAST)
    found = written(found.where(F.length("text") >= least))
    whole = docs.join(found.select(key).distinct(), key, "left_anti")
    body = _stripped(F.array_join(F.transform(F.transform(pages, tx.chunk_text), lambda p: F.coalesce(p, F.lit(""))), "\n\n"))
    rest = whole.select(key, F.posexplode(packed(body)).alias("piece", "text")).where(F.length("text") >= LEAST)
    none = lambda kind: F.lit(None).cast(kind)
    rest = rest.select(key, none("int").alias("page"), F.lit(0).alias("n"), none("string").alias("heading"), "piece", "text")
    order = F.row_number().over(Window.partitionBy(key).orderBy("page", "n", "piece")) - 1
    return found.unionByName(rest).select(key, order.alias("ord"), "heading", "text", "page")
