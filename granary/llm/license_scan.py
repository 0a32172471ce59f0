"""Licence notices and identifier tags: Aho-Corasick over words, a shunting-yard parser for expressions.

A text is taken as its words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (A-Z lower-cased), one space around
each; one automaton runs over it and finds every place of every phrase.  Phrases
are notices ("mit license") or tags ("spdx license identifier").  What stands
behind a tag, to the end of its line, is read as a licence expression: operands,
``and``, ``or``, ``with`` and parentheses go through a shunting yard, and the
longest prefix that is an expression counts.

Each licence has a restriction from 0 to 1 (``RESTRICTION``).  ``and`` takes the
larger of its sides (both bind), ``or`` the smaller (one may be chosen), ``with``
lowers a copyleft licence to that of its known exception.  The score of a text is
the largest over its expressions and its notices; a notice inside a longer one
("general public license" in "gnu lesser general public license") does not add
to the score, and gives a label only if it is a base one.

Edge cases: null text has no words; a tag without an expression gives nothing;
an identifier that is not known gives the label ``unknown``; parentheses left
open close at the end of the expression; texts of any length are taken whole and
matches never cross texts; repeated rows are treated alike; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import textbytes as tb
from granary.llm.decontam import SEPARATOR

#: phrases of the contract and their labels (fixed values)
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl",
    "gnu general public license": "gpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "common development and distribution license": "cddl", "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc", "zlib license": "zlib", "boost software license": "bsl", "permission is hereby granted free of charge": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense", "cc0 1 0 universal": "cc0", "cc by": "cc-by",
    "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc": "cc-by-nc", "cc by nc sa": "cc-by-nc", "cc by nc nd": "cc-by-nc", "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc", "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier", "license expression", "spdx license expression")
RESTRICTION = {
    "cc0": 0.0, "unlicense": 0.0, "mit": 0.1, "isc": 0.1, "zlib": 0.1, "bsl": 0.1, "bsd": 0.1, "apache": 0.2, "cc-by": 0.2,
    "epl": 0.5, "mpl": 0.5, "cddl": 0.5, "lgpl": 0.5, "unknown": 0.6, "cc-by-sa": 0.7, "gpl": 0.8, "agpl": 0.9, "cc-by-nd": 0.9, "cc-by-nc": 0.9, "proprietary": 1.0,
}
EXCEPTIONS = {"classpath-exception-2.0": 0.5, "gcc-exception-3.1": 0.3, "llvm-exception": 0.2, "openssl-exception": 0.5}

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_FAMILIES = sorted((x for x in RESTRICTION if x != "unknown"), key=len, reverse=True)


def family(identifier: str) -> str:
    """The label of a licence identifier: the longest label it is or begins with before a ``-``; else ``unknown``."""
    low = identifier.lower().rstrip("+")
    return next((x for x in _FAMILIES if low == x or low.startswith(x + "-")), "unknown")


def postfix(text: str) -> tuple[list[str], list[str]]:
    """(postfix order, tokens as they stand) of the longest prefix of ``text`` that is a licence expression; operators in lower case."""
    out: list[str] = []
    held: list[str] = []
    infix: list[str] = []
    at, operand, whole = 0, True, 0
    while m := _TOKEN.match(text, at):
        token, at = m[1], m.end()
        low = token.lower()
        if operand and token == "(":
            held.append(token)
        elif operand and token != ")" and low not in PRECEDENCE:
            out.append(token)
            operand, whole = False, len(infix) + 1
        elif not operand and low in PRECEDENCE:
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif not operand and token == ")" and "(" in held:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            whole = len(infix) + 1
        else:
            break
        infix.append(low if low in PRECEDENCE else token)
    if operand:  # what was opened behind the last operator, and the operator itself
        while held and held[-1] == "(":
            held.pop()
        held = held[:-1]
    return out + [x for x in reversed(held) if x != "("], infix[:whole]


def evaluated(text: str) -> tuple[float, list[str], str] | None:
    """(restriction, labels, the expression as it stands) of the expression that ``text`` begins with."""
    order, infix = postfix(text)
    stack: list[tuple[float, str]] = []
    for token in order:
        if token not in PRECEDENCE:
            stack.append((RESTRICTION[family(token)], token.lower()))
            continue
        (b, name), (a, _) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((min(a, EXCEPTIONS.get(name, 1.0)), ""))
        else:
            stack.append(((max if token == "and" else min)(a, b), ""))
    if not stack:
        return None
    labels = {family(x) for x, before in zip(infix, ["", *infix]) if x not in PRECEDENCE and x not in "()" and before != "with"}
    return stack[0][0], sorted(labels), " ".join(infix)


class Scanner:
    """The automaton of all phrases; made once in a worker."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        phrases = {p: (label, False) for p, label in NOTICES.items()} | {p: (label, True) for p, label in BASE.items()}
        for phrase, (label, base) in phrases.items():
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, label, base))
        for phrase in TAGS:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, None, False))
        self.automaton.make_automaton()

    def texts(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[str, int, int, bool]], list[tuple[float, list[str], str]]]]:
        """For each text: (words, notices as (label, first word, words, base), expressions)."""
        data, offsets = tb.flat(column)
        for i, j in tb.slices(offsets, 2 << 20):
            own = data[offsets[i] : offsets[j]]
            cuts = offsets[i : j + 1] - offsets[i]
            low = tb.LOWER[own]
            gap = SEPARATOR[low]
            keep = ~gap  # and the first separator after a word
            keep[1:] |= gap[1:] & ~gap[:-1]
            first = cuts[:-1][cuts[:-1] < cuts[1:]]
            keep[first] = ~gap[first]
            low[gap] = 32
            shown = low[keep].tobytes().decode("latin-1")  # a character a byte, as in the phrases
            a = 0
            for k in range(j - i):
                b = a + int(np.count_nonzero(keep[cuts[k] : cuts[k + 1]]))
                yield self._text(shown[a:b], own, int(cuts[k]), int(cuts[k + 1]))
                a = b

    def _text(self, shown: str, own: np.ndarray, begin: int, end: int):
        words = shown.count(" ") + (bool(shown) and shown[-1] != " ")
        found = [(at - x[0] + 1, x) for at, x in self.automaton.iter(f" {shown} ")]
        if not found:
            return words, [], []
        found.sort(key=lambda x: (x[0], -x[1][0]))
        notices, expressions, at, word, starts = [], [], 0, 0, None
        for p, (_, size, label, base) in found:
            word += shown.count(" ", at, p)  # spaces before p end the words before it
            at = p
            if label is not None:
                notices.append((label, word, size, base))
                continue
            if starts is None:
                gap = SEPARATOR[tb.LOWER[own[begin:end]]]
                starts = np.flatnonzero(~gap & np.append(True, gap[:-1]))
            tail = own[begin + int(starts[word + size - 1]) : end]
            line = tail[: int(np.argmax(tail == 10))] if (tail == 10).any() else tail
            value = evaluated(re.sub(r"^[^\s:=]*[\"']?\s*[:=]?\s*[\"']?", "", line.tobytes().decode("utf-8", "replace")))
            if value is not None:
                expressions.append(value)
        return words, notices, expressions


def _outer(notices: list[tuple[str, int, int, bool]]) -> list[bool]:
    """Which notices (by start, longer first) lie in no other."""
    out, reach = [], -1
    for _, start, size, _ in notices:
        out.append(start + size > reach)
        reach = max(reach, start + size)
    return out


_scanner: list[Scanner] = []
NOTICE = pa.struct([("label", pa.string()), ("word", pa.int64()), ("size", pa.int32()), ("base", pa.bool_()), ("outer", pa.bool_())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _scanner:
        _scanner.append(Scanner())
    for batch in tb.tidy(batches):
        n_words, notices, tagged, shown, score = [], [], [], [], []
        for words, own, expressions in _scanner[0].texts(batch.column(1)):
            outer = _outer(own)
            n_words.append(words)
            notices.append([{"label": x[0], "word": x[1], "size": x[2], "base": x[3], "outer": o} for x, o in zip(own, outer)])
            tagged.append(sorted({y for x in expressions for y in x[1]}))
            shown.append([x[2] for x in expressions])
            score.append(max([0.0, *(x[0] for x in expressions), *(RESTRICTION[x[0]] for x, o in zip(own, outer) if o)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(notices, pa.list_(NOTICE)), pa.array(tagged, pa.list_(pa.string())), pa.array(shown, pa.list_(pa.string())), pa.array(score, pa.float64())],
            names=["doc_id", "n_words", "notices", "tagged", "expressions", "score"],
        )


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, notices, tagged, expressions, score) of every document.

    ``notices`` holds every place of a phrase by its first word, ``tagged`` the
    labels in ``expressions``, the licence expressions behind tags.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    notice = "array<struct<label:string,word:long,size:int,base:boolean,outer:boolean>>"
    schema = f"doc_id {kind}, n_words long, notices {notice}, tagged array<string>, expressions array<string>, score double"
    return docs.select("doc_id", F.col("text").cast("string")).transform(tb.bounded).mapInArrow(_find, schema)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op13(docs: DataFrame) -> DataFrame:
    base = F.filter("notices", lambda x: x["base"])
    kept = F.filter("notices", lambda x: x["base"] | x["outer"])
    return find(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["word"]).alias("first_word"),
        F.array_max(base["word"]).alias("last_word"),
        _joined(base["label"]).alias("base_labels"),
        _joined(F.concat(kept["label"], "tagged")).alias("labels"),
        "score",
        F.array_join("expressions", "; ").alias("expressions"),
    )
