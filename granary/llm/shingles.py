"""Weighted word shingles and their ProbMinHash signatures.

Edge cases: a null or empty text, or one of white space alone, has no shingle and
a signature of zeros; a text of fewer words than a shingle is one shingle; repeated
shingles are one with their count; no texts give empty arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from granary.llm import textbytes as tb

SIZE = 5


def word_hashes(column: pa.Array, i: int, j: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word "[^\\x20\\x09-\\x0D]+" (A-Z lower-cased) of texts i to j - 1, and each text's first word."""
    part = tb.LOWER[data[offsets[i] : offsets[j]]]
    starts, ends, at = tb.words(part, offsets[i : j + 1] - offsets[i], tb.WHITE)
    return tb.span_hashes(tb.prefix_hashes(part), starts, ends), at


def shingles(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles, by text.

    A shingle is ``SIZE`` words on end; a text of fewer has one, of all its
    words; a text without words has none.
    """
    counts = np.diff(at)
    n = np.where(counts >= SIZE, counts - SIZE + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), n)
    first = np.repeat(at[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    last = np.minimum(first + SIZE, np.repeat(at[1:], n))
    hashes = tb.span_hashes(tb.prefix_hashes(words), first, last)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    where = np.flatnonzero(new)
    return text[where], hashes[where], np.diff(np.append(where, len(text)))


def prob_min_hash(text: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int, m: int) -> np.ndarray:
    """texts x m signatures; two texts agree at a place with their probability Jaccard similarity.

    Every element is a Poisson process of its weight's rate, its arrivals drawn
    from its hash; each arrival goes to a random place of the signature, which
    keeps the element that arrives first.  An element is done once its next
    arrival is later than all the text's places (early termination).
    """
    first = np.full(texts * m, np.inf)
    owner = np.zeros(texts * m, np.uint64)
    latest = np.full(texts, np.inf)
    alive = np.arange(len(text))
    when = np.zeros(len(text))
    step = 0
    while len(alive):
        step += 1
        salt = np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        draw = tb.mixed(hashes[alive] + salt)
        when = when - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / weights[alive]
        t = text[alive]
        early = when < latest[t]
        alive, when, t, draw = alive[early], when[early], t[early], draw[early]
        if not len(alive):
            break
        place = t * m + (tb.mixed(draw) % np.uint64(m)).astype(np.int64)
        before = first[place]
        better = when < before
        place, at, who = place[better], when[better], hashes[alive[better]]
        order = np.argsort(-at, kind="stable")  # the earliest is written last
        first[place[order]] = at[order]
        owner[place[order]] = who[order]
        # the latest place matters once all places are taken, so it need not be looked up at once
        if step < 16 or step % 4 == 0:
            touched = np.unique(t)
            latest[touched] = first.reshape(texts, m)[touched].max(1)
            still = when < latest[t]
            alive, when = alive[still], when[still]
    return owner.reshape(texts, m)


def similarities(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(probability Jaccard, plain Jaccard) of pairs of texts given as (text, hash, count) of equal numbering.

    The probability Jaccard is the sum over shared elements of
    1 / sum_k max(a_k / a_d, b_k / b_d).
    """
    (ta, ha, wa), (tb_, hb, wb) = a, b
    pairs = int(max(ta.max(initial=-1), tb_.max(initial=-1))) + 1
    probability, plain = np.zeros(pairs), np.zeros(pairs)
    at, bt = np.searchsorted(ta, np.arange(pairs + 1)), np.searchsorted(tb_, np.arange(pairs + 1))
    for k in range(pairs):
        x, y = slice(at[k], at[k + 1]), slice(bt[k], bt[k + 1])
        _, i, j = np.intersect1d(ha[x], hb[y], assume_unique=True, return_indices=True)
        na, nb = at[k + 1] - at[k], bt[k + 1] - bt[k]
        if not len(i):
            continue
        plain[k] = len(i) / (na + nb - len(i))
        p, q = wa[x].astype(float), wb[y].astype(float)
        only_a, only_b = p.sum() - p[i].sum(), q.sum() - q[j].sum()
        p, q = p[i], q[j]
        # sum_k max(p_k / p_d, q_k / q_d): shared elements by the order of their ratio
        order = np.argsort(p / q, kind="stable")
        p, q = p[order], q[order]
        above = np.cumsum(p[::-1])[::-1] - p  # those of a larger ratio count by p
        below = np.cumsum(q)
        probability[k] = (1 / ((above + only_a) / p + (below + only_b) / q)).sum()
    return probability, plain
