"""Byte-level BPE with vectorised pre-tokenisation.

Texts of a batch become one array of code points. A table gives each code point its
class (letter, number, white space, other), and a look at the next few gives each
position a symbol. Token boundaries are the output of a small automaton over symbols.
The functions that symbols induce on its states are closed under composition; the
closure is a finite table, so composing is a look-up and associative. A blocked scan
composes blocks, then the blocks' results, and replays each block from its true
state: two look-ups per character and no regular expression.

Slices between boundaries are encoded by merging byte pairs in rank order; a bounded
cache keeps the ids of slices seen before. Offsets of tokens in the decoded bytes are
kept, and decoding is a gather from one byte array of the whole vocabulary.

Defined results: null is the empty text, which has no tokens. Ids may repeat and be
null. Empty tables give empty results. Other columns are ignored. Vocabularies are
read on the driver and sent to the tasks (a fixed size, under 2 MB).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelkit.llm.frames import text_or_empty

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# Fixed value: the white space of the pattern's \s.
WHITE = "\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
# Letters and numbers that Unicode 16.0 added.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)
# Fixed value: the contractions of the pattern, by their letters.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# Characters of a text batch that are scanned at once.
SCAN_CHARS = 1 << 19
CACHE_SLICES = 800_000
BLOCK = 256


# --- boundaries ---------------------------------------------------------------------


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point by Unicode 16.0, as in the tokenizer library; Python's own tables may be older."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        out[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
    for kind, ranges in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for first, last in ranges:
            out[first:last + 1] = kind
    for c in WHITE:
        out[ord(c)] = SPACE
    return out


# Symbols: what a position is, with the look ahead that a decision needs.
(S_LETTER, S_NUMBER, S_OTHER, S_BLANK_LAST, S_BLANK, S_WHITE_LAST, S_WHITE, S_SHORT, S_LONG, S_START) = range(10)
# States: what the open token is. GLUE holds a blank that joins the token to come, TAIL1
# and TAIL2 wait for the letters of a contraction, FRESH forces a start.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, GLUE, IN_WHITE, TAIL1, TAIL2 = range(8)
STATES = 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a token starts here."""
    if symbol == S_START:
        return FRESH, False
    if symbol in (S_LETTER, S_NUMBER, S_OTHER):
        if symbol == S_LETTER and state in (TAIL1, TAIL2):
            return (FRESH if state == TAIL1 else TAIL1), False
        own = (IN_LETTERS, IN_NUMBERS, IN_OTHER)[symbol]
        return own, state not in (own, GLUE)
    if symbol in (S_SHORT, S_LONG):  # an apostrophe before a contraction's letters
        if state in (IN_OTHER, GLUE):
            return IN_OTHER, False
        return (TAIL1 if symbol == S_SHORT else TAIL2), True
    if symbol in (S_BLANK, S_WHITE):  # more white space or the end follows
        return IN_WHITE, state != IN_WHITE
    return (GLUE if symbol == S_BLANK_LAST else FRESH), True


class Automaton:
    """Composition closure of the symbols' functions, as tables."""

    def __init__(self) -> None:
        symbols = [tuple(_step(s, y)[0] for s in range(STATES)) for y in range(10)]
        self.starts = np.array([[_step(s, y)[1] for y in range(10)] for s in range(STATES)])
        known = {tuple(range(STATES)): 0}
        for f in symbols:
            known.setdefault(f, len(known))
        todo = list(known)
        while todo:
            f = todo.pop()
            for g in symbols:
                h = tuple(g[f[s]] for s in range(STATES))
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
        functions = sorted(known, key=known.get)
        self.of_symbol = np.array([known[f] for f in symbols], np.int16)
        # then[f, g]: first f, then g.
        self.then = np.array([[known[tuple(g[f[s]] for s in range(STATES))] for g in functions] for f in functions], np.int16)
        self.end = np.array([f[FRESH] for f in functions], np.uint8)
        self.next = np.array([[f[s] for f in symbols] for s in range(STATES)], np.uint8)


@lru_cache(1)
def automaton() -> Automaton:
    return Automaton()


def symbols(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbol of each position; `starts` are the positions of the texts' leading sentinels."""
    kind = classes()[codes]
    out = np.array([S_LETTER, S_NUMBER, S_WHITE, S_OTHER], np.uint8)[kind]
    out[kind == OTHER] = S_OTHER
    sentinel = np.zeros(len(codes) + 1, bool)
    sentinel[starts] = True
    sentinel[-1] = True
    # The last of a run of white space, with something after it in the same text.
    white = kind == SPACE
    last = white & ~np.append(white[1:], False) & ~sentinel[1:]
    blank = codes == 0x20
    out[white & blank] = S_BLANK
    out[last] = S_WHITE_LAST
    out[last & blank] = S_BLANK_LAST
    quote = np.flatnonzero(codes == 0x27)
    if len(quote):
        ahead = np.append(codes, np.zeros(2, codes.dtype))
        one, two = ahead[quote + 1], ahead[quote + 2]
        inside = ~sentinel[quote + 1]
        both = inside & ~sentinel[np.minimum(quote + 2, len(codes))]
        short, long_ = np.zeros(len(quote), bool), np.zeros(len(quote), bool)
        for c in CONTRACTIONS:
            if len(c) == 1:
                short |= inside & (one == ord(c))
            else:
                long_ |= both & (one == ord(c[0])) & (two == ord(c[1]))
        out[quote[short]] = S_SHORT
        out[quote[long_ & ~short]] = S_LONG
    out[starts] = S_START
    return out


def boundaries(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a token starts at each position. A sentinel precedes each text and starts none."""
    machine, n = automaton(), len(codes)
    rows = -(-n // BLOCK)
    sym = np.full(rows * BLOCK, S_START, np.uint8)
    sym[:n] = symbols(codes, starts)
    columns = np.ascontiguousarray(sym.reshape(rows, BLOCK).T)
    # 1. The function of each block. 2. Their scan. 3. Each block from its true state.
    whole = np.zeros(rows, np.int16)
    for column in columns:
        whole = machine.then[whole, machine.of_symbol[column]]
    step = 1
    while step < rows:
        whole[step:] = machine.then[whole[:-step], whole[step:]]
        step *= 2
    state = np.append(np.uint8(FRESH), machine.end[whole[:-1]])
    out = np.empty((BLOCK, rows), bool)
    for i, column in enumerate(columns):
        out[i] = machine.starts[state, column]
        state = machine.next[state, column]
    return out.T.ravel()[:n]


def slices(texts: list[str]) -> Iterator[tuple[bytes, list[int]]]:
    """Per text: its bytes and the byte offsets where slices start, plus the end."""
    at, group = 0, []
    for t in texts:
        group.append(t)
        at += len(t) + 1
        if at >= SCAN_CHARS:
            yield from _slices(group)
            at, group = 0, []
    if group:
        yield from _slices(group)


def _slices(texts: list[str]) -> Iterator[tuple[bytes, list[int]]]:
    codes = np.frombuffer("".join(f"\0{t}" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    marks = np.flatnonzero(boundaries(codes, starts))
    # Bytes of UTF-8 before each position; sentinels count none.
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    width[starts] = 0
    before = np.cumsum(width) - width
    total = before[-1] + width[-1]
    base = before[starts]
    upto = np.append(base[1:], total)
    cut = np.searchsorted(marks, np.append(starts, len(codes)))
    offsets = before[marks]
    for i, t in enumerate(texts):
        own = offsets[cut[i]:cut[i + 1]] - base[i]
        yield t.encode("utf-8", "surrogatepass"), own.tolist() + [int(upto[i] - base[i])]


# --- merging and decoding -----------------------------------------------------------


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary in rank order from a rank file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Encoder(dict):
    """Slice -> its ids as little-endian 32-bit bytes; a bounded cache in front of the merges."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        super().__init__()
        self.rank = {token: i for i, token in enumerate(vocabulary)}
        self.sizes = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
        self.at = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(vocabulary), np.uint8)

    def __missing__(self, piece: bytes) -> bytes:
        r = self.rank.get(piece)
        ids = [r] if r is not None else self.merge(piece) if len(piece) <= 48 else self.merge_long(piece)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(piece) <= 64:  # long slices hardly come twice
            if len(self) >= CACHE_SLICES:
                self.clear()
            self[piece] = packed
        return packed

    def merge(self, piece: bytes) -> list[int]:
        """Joins the adjacent pair of lowest rank, leftmost first, until none is in the vocabulary."""
        rank, none = self.rank.get, sys.maxsize
        tokens = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [rank(a + b, none) for a, b in zip(tokens, tokens[1:])]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            tokens[i:i + 2] = [tokens[i] + tokens[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(tokens[i - 1] + tokens[i], none)
            if i < len(pairs):
                pairs[i] = rank(tokens[i] + tokens[i + 1], none)
        return [self.rank[t] for t in tokens]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap over a linked list, n log n."""
        n, rank = len(piece), self.rank.get
        end = list(range(1, n + 1))  # end of the token that starts here; 0: none does
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i:i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := rank(piece[i:end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                prev[stop] = i
                offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        out, i = [], 0
        while i < n:
            out.append(self.rank[piece[i:end[i]]])
            i = end[i]
        return out

    def encode(self, data: bytes, cuts: list[int]) -> np.ndarray:
        """Ids of a text whose slices start at `cuts` (the last is its end)."""
        packed = b"".join(map(self.__getitem__, [data[a:b] for a, b in zip(cuts, cuts[1:])]))
        return np.frombuffer(packed, "<u4")

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the decoded text, and the end."""
        return np.append(0, np.cumsum(self.sizes[ids]))

    def decode(self, ids: np.ndarray) -> bytes:
        """Gathers each token's bytes from the vocabulary's byte array."""
        offsets = self.offsets(ids)
        shift = np.repeat(self.at[ids] - offsets[:-1], self.sizes[ids])
        return self.bytes[np.arange(offsets[-1]) + shift].tobytes()


# --- the operator ----------------------------------------------------------------------


def _encoder(vocabulary, memo: dict = {}) -> Encoder:  # noqa: B006  one encoder per worker and vocabulary
    key = vocabulary.value[0]
    if key not in memo:
        memo.clear()
        memo[key] = Encoder(vocabulary.value[1])
    return memo[key]


def encode_documents(
    docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text", *, keep_ids: bool = False
) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip; with `keep_ids` also ids and offsets (arrays)."""
    vocabulary = read_ranks(ranks_path)
    digest = hashlib.sha256(b"\n".join(vocabulary)).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((digest, vocabulary))
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    schema += ", ids array<long>, offsets array<long>" if keep_ids else ""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for f in frames:
            out: list[tuple] = []
            for data, cuts in slices(f.column(1).to_pylist()):
                ids = encoder.encode(data, cuts)
                back = encoder.decode(ids)
                row = (len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), back == data)
                out.append(row + ((ids.tolist(), encoder.offsets(ids).tolist()) if keep_ids else ()))
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"] + ["ids", "offsets"] * keep_ids
            types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = zip(*out) if out else [()] * len(names)
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([f.column(0), *arrays], ["doc_id", *names])

    return rows.mapInArrow(run, schema)
