"""Plain versions of the operators' contracts, one text at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeats(texts, size=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(texts):
    """Least index of each text's class; equal texts or a Jaccard similarity of 0.8 link."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (texts[i] or "") == (texts[j] or "") or (both and both / len(sets[i] | sets[j]) >= 0.8):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def private(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), rank, kind, m.end()))
    found.sort()
    digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in found).encode()).hexdigest()
    return (*[sum(x[2] == k for x in found) for k in PATTERNS], digest)


WORDS4 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contaminated(texts, items, size=10):
    windows = {}
    for item, text in items:
        w = WORDS4.findall(lower(text))
        k = min(size, len(w))
        for s in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[s : s + k]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, own = WORDS4.findall(lower(text)), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                found = windows.get(tuple(w[s : s + k]))
                if found:
                    hit.update(range(s, s + k))
                    own |= found
        out.append((len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


def quality(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed)


def unigrams(rows):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score)} of (doc_id, text)."""
    own = {k: re.findall("[^\x20\x09-\x0d]+", lower(t)) + ["\n"] for k, t in rows}
    c = Counter()
    for k, t in own.items():
        if k is not None and zlib.crc32(str(k).encode()) % 10:
            c.update(t)
    n, v = sum(c.values()), len(c)
    return {
        k: (len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t))
        for k, t in own.items()
    }
