"""Text functions that no built-in expression has, in Arrow batches."""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nearness(query: list[str], words: list[str]) -> float:
    """How near the query's terms stand: 1 for one term or a span within max(3 m, 12), else that over the span; 0 for none.

    The span is last less first position of the smallest window that holds every matched term.
    """
    wanted = set(query) & set(words)
    m = len(wanted)
    if m < 2:
        return float(m)
    last: dict[str, int] = {}
    best = len(words)
    for k, w in enumerate(words):
        if w in wanted:
            last[w] = k
            if len(last) == m:
                best = min(best, k - min(last.values()))
    ideal = max(3 * m, 12)
    return 1.0 if best <= ideal else ideal / best


@F.pandas_udf(T.DoubleType())
def proximity(query: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([nearness(list(q), list(w)) for q, w in zip(query, words)], dtype="float64")


#: encodings tried in this order; the last takes any bytes
ENCODINGS = ("utf-8", "cp1251", "utf-16", "latin-1")


def decoded(content: bytes) -> str:
    for encoding in ENCODINGS[:-1]:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            pass
    return content.decode(ENCODINGS[-1])


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """Bytes by the first encoding that takes them."""
    return content.map(lambda x: None if x is None else decoded(bytes(x)))


_WORD = re.compile("[a-zа-яё0-9]+")


@functools.lru_cache(1 << 16)
def _place(gram: str) -> tuple[int, float]:
    digest = hashlib.blake2b(gram.encode(), digest_size=8).digest()
    return int.from_bytes(digest[:4], "little"), 1.0 if digest[4] % 2 else -1.0


def hashed(text: str, dims: int) -> np.ndarray:
    """Signed counts of words and of the 3- and 4-grams of words between ^ and $, as a unit vector (zero without words)."""
    out = np.zeros(dims, np.float32)
    for word, n in Counter(_WORD.findall(text.lower())).items():
        edged = f"^{word}$"
        for gram in (word, *(edged[i : i + k] for k in (3, 4) for i in range(len(edged) - k + 1))):
            place, sign = _place(gram)
            out[place % dims] += sign * n
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """Feature-hashed embedding of whole texts; null is empty."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: hashed(x or "", dims).tolist())

    return embed(text)
