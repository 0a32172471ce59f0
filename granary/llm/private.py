"""Personal data, in DataFrame functions only.

Regular expressions propose spans; Luhn (cards), mod 97 (IBANs) and the range
of each part (addresses) confirm them; words near a span move its score.

The patterns are the given ones in forms that never backtrack over a long run:
a possessive loop where the next character decides, and a start allowed only
where a run begins or right after the match before (``\\G``).  They match the
same spans and stay linear, without deep recursion, on texts of any length.
Offsets are running totals by levels and parts of a text are read from its
pieces, so time stays linear in the matches as well.

Edge cases: null text is empty; spans of different kinds may overlap; repeated
rows are treated alike; an empty table gives no rows; further columns are kept
by ``redact`` and ignored by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.quality import let
from granary.llm.scratch import free

# fixed values: kinds in their order of rank, patterns, base scores, context words
KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?+[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8}
NEAR = {
    "email": "mail|contact|write|reply",
    "ip": "addr|host|server|login|client",
    "card": "card|visa|payment|credit|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
# words that speak against a kind, matched whole
AGAINST = {"email": "dummy", "ip": "version|release|build", "card": "dummy|sample", "phone": "dummy", "iban": "dummy|sample"}
REACH = 40
# how arrays and texts are taken apart
FAN = 32
LEVELS = 3
PIECE = 1024
SPAN = "struct<s:int,r:int,e:int,k:string,c:double>"


def running(values: Column, start: int, step) -> Column:
    """For each value, ``step`` over all values before it, from ``start``.

    ``step`` is a sum or a maximum.  Totals of ``FAN`` values, of ``FAN`` such totals and so on
    leave at most ``FAN`` terms a level for each value: linear up to ``FAN`` to
    the number of levels, where no array grows by one value at a time.
    """

    def total(xs: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(xs, (first + 1).cast("int"), n.cast("int")), F.lit(start), step)

    def above(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / FAN).cast("int")), lambda j: total(xs, j * FAN, F.lit(FAN)))

    def level(xs: Column, sums: list[Column], left: int) -> Column:
        if left:
            return let(above(xs), lambda up: level(up, [*sums, xs], left - 1))
        own = [*sums, xs]

        def at(_: Column, i: Column) -> Column:
            parts = []
            for depth, s in enumerate(own):
                place = F.floor(i / FAN**depth).cast("int")
                begin = F.lit(0) if depth == len(own) - 1 else place - place % FAN
                parts.append(total(s, begin, place - begin))
            return F.aggregate(F.array(*parts), F.lit(start), step)

        return F.transform(own[0], at)

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(values, lambda xs: level(xs, [], LEVELS)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s,e,m>>: every match with its code point offsets.

    The gaps that ``split`` leaves between the matches give the offsets.
    """
    kind = "array<struct<s:int,e:int,m:string>>"

    def placed(hits: Column, gaps: Column) -> Column:
        sizes = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(F.length(g).alias("g"), F.length(h).alias("h"), h.alias("m")))
        return let(
            sizes,
            lambda z: F.zip_with(
                z,
                running(F.transform(z, lambda x: x["g"] + x["h"]), 0, lambda a, x: a + x),
                lambda x, before: F.struct((before + x["g"]).alias("s"), (before + x["g"] + x["h"]).alias("e"), x["m"].alias("m")),
            ),
        )

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) == 0, F.array().cast(kind)).otherwise(
            let(F.split(text, pattern, -1), lambda gaps: placed(hits, gaps))
        ),
    )


def blocks_of(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points, so that a part of it is read without what lies before."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(blocks: Column, start: Column, end: Column) -> Column:
    """The text between two code point offsets."""
    a, b = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    head = F.coalesce(F.get(blocks, a), F.lit(""))
    return F.when(a == b, F.substring(head, start % PIECE + 1, end - start)).otherwise(
        F.concat(
            F.substring(head, start % PIECE + 1, F.lit(PIECE)),
            F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""),
            F.substring(F.coalesce(F.get(blocks, b), F.lit("")), F.lit(1), end % PIECE),
        )
    )


def luhn(digits: Column) -> Column:
    """Whether the digit string passes the Luhn check."""
    total = F.aggregate(
        F.transform(
            F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
            lambda c, i: let(
                c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)
            ),
        ),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN without spaces passes the mod 97 check."""
    turned = F.concat(F.substring(code, 5, 1000), F.substring(code, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c < "A", (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return let(F.replace(m, F.lit(" "), F.lit("")), lambda c: F.when(F.length(c).between(15, 34), mod97(c)).otherwise(False))


def score(kind: str, blocks: Column, x: Column) -> Column:
    """The kind's base score, moved by words within ``REACH`` code points of the span.

    Words against it count only whole: one more code point on either side tells
    whether the reach cuts a word.
    """
    side = REACH + 1
    around = F.concat(
        F.lpad(part(blocks, F.greatest(x["s"] - side, F.lit(0)), x["s"]), side, "\n"),
        F.lit("\n"),
        F.rpad(part(blocks, x["e"], x["e"] + side), side, "\n"),
    )
    whole = rf"(?Us)(?<=.)\b(?:{AGAINST[kind]})s?\b(?=.)"
    return let(
        around,
        lambda c: F.round(
            F.lit(SCORES[kind])
            + F.when(F.lower(F.substring(c, 2, 2 * REACH + 1)).rlike(NEAR[kind]), 0.2).otherwise(0.0)
            - F.when(F.lower(c).rlike(whole), 0.3).otherwise(0.0),
            2,
        ),
    )


def confirmed_spans(kind: str, rank: int, text: Column) -> Column:
    return F.transform(
        F.filter(matches(text, PATTERNS[kind]), lambda x: confirmed(kind, x["m"])),
        lambda x: F.struct(
            x["s"].alias("s"), F.lit(rank).alias("r"), x["e"].alias("e"), F.lit(kind).alias("k"), F.lit(0.0).alias("c")
        ).cast(SPAN),
    )


def spans(text: Column) -> Column:
    """All confirmed spans by start, then rank of kind: array<struct<s,r,e,k,c>>."""
    none = F.array().cast(f"array<{SPAN}>")
    parts = []
    for rank, kind in enumerate(KINDS):
        found = confirmed_spans(kind, rank, text)
        if kind in NEEDS:
            found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(none)
        parts.append(found)

    def scored(blocks: Column, x: Column) -> Column:
        c = F.lit(0.0)
        for rank, kind in enumerate(KINDS):
            c = F.when(x["r"] == rank, score(kind, blocks, x)).otherwise(c)
        return F.struct(x["s"].alias("s"), x["r"].alias("r"), x["e"].alias("e"), x["k"].alias("k"), c.alias("c")).cast(SPAN)

    return let(
        F.sort_array(F.concat(*parts)),
        lambda xs: F.when(F.size(xs) == 0, none).otherwise(let(blocks_of(text), lambda b: F.transform(xs, lambda x: scored(b, x)))),
    )


def listed(xs: Column) -> Column:
    return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Counts of each kind, the digest of the base spans and all spans of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("__t")).select("doc_id", spans(F.col("__t")).alias("__s"))
    count = lambda k: F.size(F.filter("__s", lambda x: x["k"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(listed(F.filter("__s", lambda x: x["r"] < len(BASE_KINDS))), 256).alias("base_sha256"),
        listed(F.col("__s")).alias("spans"),
        count("iban"),
        F.coalesce(F.array_max(F.transform("__s", lambda x: x["c"])), F.lit(0.0)).alias("max_score"),
    )


def redact(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """``docs`` with every span of score ``least`` or more replaced by its kind in brackets.

    Overlapping spans are replaced as one, by the kind of the first.
    """
    cols = docs.columns
    spans_name = free(cols, "spans")

    def masked(text: Column, xs: Column) -> Column:
        """A span that begins before all earlier ones have ended adds to their run; ``before`` is where these end."""

        def joined(blocks: Column, runs: Column, end: Column) -> Column:
            pieces = F.transform(runs, lambda x: F.concat(part(blocks, x["before"], x["s"]), F.lit("["), F.upper(x["k"]), F.lit("]")))
            return F.concat(F.array_join(pieces, ""), part(blocks, end, F.length(text)))

        ends = F.transform(xs, lambda x: x["e"])
        runs = F.filter(
            F.zip_with(
                xs,
                running(ends, 0, lambda a, x: F.greatest(a, x)),
                lambda x, before: F.struct(x["s"].alias("s"), x["k"].alias("k"), before.alias("before")),
            ),
            lambda x: x["s"] >= x["before"],
        )
        return let(blocks_of(text), lambda b: let(runs, lambda r: joined(b, r, F.array_max(ends))))

    marked = docs.withColumn(spans_name, F.filter(spans(F.coalesce(F.col("text"), F.lit(""))), lambda x: x["c"] >= least))
    new = F.when(F.size(spans_name) > 0, masked(F.col("text"), F.col(spans_name))).otherwise(F.col("text"))
    out = marked.withColumn("text", new)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in cols])


def op3(docs: DataFrame) -> DataFrame:
    return find(docs)
