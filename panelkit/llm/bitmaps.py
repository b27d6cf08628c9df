"""Word shingles as sets, and parity bitmaps that bound the similarity of two sets.

A set's bitmap of b bits (a power of two near its size) holds at bit h mod b the parity of
its members there. Two bitmaps of one width differ in at most as many bits as the sets
have members in only one of them, and a bitmap folds to half its width by XOR of its
halves. So the differing bits prove that many pairs are not similar, at an eighth of a
byte a member; pairs that are similar are never turned away.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

SEED = 42
# Bits of a bitmap.
NARROW, WIDE = 64, 1 << 16
# The odd number that joins the hashes of adjacent words.
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers: multiplications between shifts."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes (signed) of the word shingles; fewer words are one shingle, none the empty set.

    A shingle's hash is a polynomial in its words' XXH64, with the number of words as start, mixed once.
    """
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out *= STEP
        out += hashes[i:i + len(out)]
    out = np.sort(_mixed(out).view(np.int64))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def bitmap(members: np.ndarray) -> bytes:
    """The parity bitmap of a set."""
    width = NARROW
    while width < len(members) and width < WIDE:
        width *= 2
    return np.packbits(np.bincount(members & (width - 1), minlength=width).astype(np.uint8) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Members in only one of two sets, at least."""
    if len(a) < len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def may_be_similar(na: int, a: bytes, nb: int, b: bytes, num: int, den: int) -> bool:
    """False only where the Jaccard similarity is below num / den: at J >= t at most (1 - t) / (1 + t) of both sizes differ."""
    return differing(a, b) * (den + num) <= (na + nb) * (den - num)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Jaccard similarity of two sets of at least num / den, in whole numbers; two empty sets are similar."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * den >= num * (len(a) + len(b) - both)
