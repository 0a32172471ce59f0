"""Token counts by two compiled finite-state transducers.

The first reads classes of characters (with a bounded look ahead folded into
the class) and emits a mark where a pretoken starts.  Each block of a text is
run from all states at once, which gives the block's state map; the maps are
composed by a parallel prefix scan; then every block is run from its one true
state to emit its marks.

The second reads the bytes of a pretoken and annotates every transition with
the change of the token count.  Byte-pair encoding of each prefix ends in one
token, the longest one that may follow the token before it; so a state is the
part of the pretoken that may still be the beginning of a token, with the last
token and relative count at each boundary in it.  States are compiled when first
reached.  It runs once for each distinct pretoken of a batch.

Edge cases: null and empty texts have no tokens; a special string in a text is
one token, as by the library's default; repeated rows are treated alike; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm import textbytes as tb

SLICE_BYTES = 4 << 20
BLOCK = 256
MAX_STATES = 400_000

# states and classes of the pretoken transducer
CLOSED, LETTERS, NUMBERS, OTHERS, WHITES, LEAD, ONE_MORE, TWO_MORE = range(8)
C_LETTER, C_NUMBER, C_OTHER, C_SHORT, C_LONG, C_WHITE, C_LAST_SPACE, C_LAST_WHITE = range(8)
RESTART, PAD = 8, 16
NO_BOUNDARY = (-2, 0)


def pretoken_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emits) by state * 32 + class; class + RESTART begins a text, PAD changes nothing."""
    step, emit = np.zeros((8, 32), np.uint8), np.zeros((8, 32), np.uint8)
    for state in range(8):
        for c in range(8):
            if state == ONE_MORE:
                to, mark = CLOSED, 0
            elif state == TWO_MORE:
                to, mark = ONE_MORE, 0
            elif c in (C_LETTER, C_NUMBER, C_OTHER):
                run = {C_LETTER: LETTERS, C_NUMBER: NUMBERS, C_OTHER: OTHERS}[c]
                to, mark = run, int(state not in (run, LEAD))
            elif c in (C_SHORT, C_LONG):
                if state in (OTHERS, LEAD):
                    to, mark = OTHERS, 0
                else:
                    to, mark = (ONE_MORE if c == C_SHORT else TWO_MORE), 1
            elif c == C_WHITE:
                to, mark = WHITES, int(state != WHITES)
            else:
                to, mark = (LEAD if c == C_LAST_SPACE else CLOSED), 1
            step[state, c], emit[state, c] = to, mark
        step[state, PAD] = state
    step[:, RESTART:PAD] = step[CLOSED, :8]
    emit[:, RESTART:PAD] = emit[CLOSED, :8]
    return step.ravel(), emit.ravel()


_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space (3) or other."""
    global _classes
    if _classes is None:
        kinds = {"L": C_LETTER, "N": C_NUMBER, "Z": 3}
        _classes = np.array([kinds.get(unicodedata.category(chr(c))[0], C_OTHER) for c in range(0x110000)], np.uint8)
        _classes[[9, 10, 11, 12, 13, 0x85]] = 3
    return _classes


def pretoken_starts(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Indices at which a pretoken starts; ``edges`` are the starts of the texts and the end of the last."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = char_classes()[points]
    last = np.zeros(n, dtype=bool)
    ends = edges[1:] - 1
    last[ends[ends >= 0]] = True
    following = np.zeros(n, np.uint32)
    following[:-1] = points[1:]
    following[last] = 0
    white = kind == 3
    white_next = np.ones(n, dtype=bool)
    white_next[:-1] = white[1:]
    white_next[last] = True
    cls = kind.copy()
    cls[white] = C_WHITE
    single = white & ~white_next
    cls[single] = np.where(points[single] == 0x20, C_LAST_SPACE, C_LAST_WHITE)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        a = following[quotes]
        b = following[np.minimum(quotes + 1, n - 1)]
        b = np.where(a == 0, 0, b)
        r, v, l, e = map(ord, "rvle")
        cls[quotes[np.isin(a, [ord(x) for x in "stmd"])]] = C_SHORT
        cls[quotes[((a == r) & (b == e)) | ((a == v) & (b == e)) | ((a == l) & (b == l))]] = C_LONG
    begins = edges[:-1]
    begins = begins[begins < n]
    cls[np.unique(begins)] += RESTART
    step, emit = pretoken_transducer()
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, PAD, np.uint8)
    grid[:n] = cls
    columns = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    # every block from every state
    maps = np.tile(np.arange(8, dtype=np.uint8)[:, None], (1, blocks))
    for column in columns:
        maps = step[(maps << 5) | column]
    # inclusive prefix composition of the blocks' maps
    scan, d = maps, 1
    while d < blocks:
        ahead = scan.copy()
        ahead[:, d:] = np.take_along_axis(scan[:, d:], scan[:, :-d], axis=0)
        scan, d = ahead, d * 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = scan[CLOSED, :-1]
    marks = np.empty((BLOCK, blocks), np.uint8)
    for k, column in enumerate(columns):
        at = (state << 5) | column
        marks[k] = emit[at]
        state = step[at]
    return np.flatnonzero(marks.T.ravel()[:n])


class CountTransducer:
    """Deterministic transducer from the bytes of a pretoken to its number of tokens."""

    def __init__(self, rank_file: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.begins = {t[:k] for t in self.ranks for k in range(len(t))}
        self.merge = tiktoken.Encoding("ranks", pat_str="x", mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
        self.follows: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = (b"", ((-1, 0),))
        self.states, self.known, self.step = [start], {start: 0}, {}

    def may_follow(self, left: int, token: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens (left -1: of the one)."""
        key = (left, token)
        if key not in self.follows:
            if len(self.follows) > 4 * MAX_STATES:
                self.follows.clear()
            want = [token] if left < 0 else [left, token]
            self.follows[key] = self.merge(b"".join(self.bytes_of[t] for t in want)) == want
        return self.follows[key]

    def compiled(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: (next state, change of the count)."""
        window, bounds = self.states[state]
        window += bytes([byte])
        for k in range(len(window)):
            token = self.ranks.get(window[k:])
            if token is not None and self.may_follow(bounds[k][0], token):
                change = bounds[k][1] + 1
                break
        else:
            raise ValueError("a byte without a token")
        cut = next(k for k in range(len(window) + 1) if window[k:] in self.begins)
        # a boundary from which no token can go on any more is of no account
        rest = [
            (bounds[k][0], bounds[k][1] - change) if window[k:] in self.begins else NO_BOUNDARY
            for k in range(cut, len(window))
        ]
        ahead = (window[cut:], (*rest, (token, 0)))
        if ahead not in self.known:
            self.known[ahead] = len(self.states)
            self.states.append(ahead)
        self.step[state << 8 | byte] = found = (self.known[ahead], change)
        return found

    def count(self, pretoken: bytes) -> int:
        state = total = 0
        step = self.step
        for byte in pretoken:
            found = step.get(state << 8 | byte)
            if found is None:
                found = self.compiled(state, byte)
            state, change = found
            total += change
        return total

    def counts(self, pretokens: list[bytes]) -> np.ndarray:
        if len(self.states) > MAX_STATES:
            self.reset()
        return np.fromiter(map(self.count, pretokens), np.int64, len(pretokens))


_transducers: dict[str, CountTransducer] = {}


def transducer(rank_file: str) -> CountTransducer:
    if rank_file not in _transducers:
        _transducers[rank_file] = CountTransducer(rank_file)
    return _transducers[rank_file]


def _special(data: np.ndarray, offsets: np.ndarray, special: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments (bounds, text of each, whether it is a special string)."""
    found, raw, at = [], data.tobytes(), 0
    while special and (at := raw.find(special, at)) >= 0:
        text = np.searchsorted(offsets, at, side="right") - 1
        if at + len(special) <= offsets[text + 1]:
            found.append(at)
            at += len(special)
        else:
            at += 1
    starts = np.array(found, np.int64)
    cuts = np.unique(np.concatenate([offsets, starts, starts + len(special)]))
    return cuts, np.searchsorted(offsets, cuts[:-1], side="right") - 1, np.isin(cuts[:-1], starts)


def text_counts(column: pa.Array, t: CountTransducer, special: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each text of the column."""
    data, offsets = tb.flat(column)
    tokens = np.zeros(len(offsets) - 1, np.int64)
    for i, j in tb.slices(offsets, SLICE_BYTES):
        part = data[offsets[i] : offsets[j]]
        if not len(part):
            continue
        cuts, text, is_special = _special(part, offsets[i : j + 1] - offsets[i], special.encode())
        points = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((part & 0xC0) != 0x80)
        starts = lead[pretoken_starts(points, np.searchsorted(lead, cuts))]
        codes = tb.pieces(part, np.append(starts, len(part))).dictionary_encode()
        counts = t.counts(codes.dictionary.to_pylist())[np.asarray(codes.indices)]
        segment = np.searchsorted(cuts, starts, side="right") - 1
        counts[is_special[segment]] = 0
        tokens[i:j] = np.bincount(text[segment], weights=counts, minlength=j - i).astype(np.int64)
        np.add.at(tokens, i + text[is_special], 1)
    return np.diff(offsets), tokens


def count_tokens(docs: DataFrame, rank_file: str, special: str = "") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(rank_file)
        for batch in tb.tidy(batches):
            n_bytes, n_tokens = text_counts(batch.column(1), t, special)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select("doc_id", "text").transform(tb.bounded).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op8(docs: DataFrame, limit: int = 1024) -> DataFrame:
    import public_tokenizers

    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), "<|endoftext|>")
    return out.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {limit} AS over_limit")
