"""Word, token and shingle hashes of whole texts."""

from __future__ import annotations

import unicodedata

import numpy as np
from xxhash import xxh3_64_intdigest

#: Ranges of scripts that write no spaces between words (Han, kana, bopomofo, Yi, Thai, Lao, Burmese, Khmer and kin).
_UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
_JOIN = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (fixed constants of the public splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> np.ndarray:
    """A hash of each word between white space (space, tab to carriage return); upper and lower case A-Z count as equal."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def _kinds() -> np.ndarray:
    """For each code point: 0 between tokens, 1 part of a word, 2 a token of its own."""
    kinds = np.array([(c := chr(i)).isalnum() or unicodedata.category(c)[0] == "M" for i in range(0x110000)]).astype(np.uint8)
    for first, last in _UNSPACED:
        kinds[first : last + 1] *= 2
    return kinds


_kind: np.ndarray | None = None


def tokens(text: str) -> np.ndarray:
    """A hash of each token of the case-folded text: a run of Unicode letters, digits and their marks.

    In scripts without spaces each character is a token. Composed and decomposed letters are equal.
    """
    global _kind
    if _kind is None:
        _kind = _kinds()
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    data = folded.encode("utf-32-le", "surrogatepass")
    kind = _kind[np.frombuffer(data, np.uint32)]
    at = np.flatnonzero(kind)
    if not len(at):
        return np.empty(0, np.uint64)
    new = (np.diff(at, prepend=-2) != 1) | (kind[at] == 2) | (kind[np.maximum(at - 1, 0)] == 2)
    start = np.flatnonzero(new)
    first, last = (4 * at[start]).tolist(), (4 * at[np.append(start[1:], len(at)) - 1] + 4).tolist()
    raw = memoryview(data)
    return np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip(first, last)), np.uint64, len(first))


def runs(word: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row, in order."""
    n = len(word) - k + 1
    out = word[:n].copy()
    for j in range(1, k):
        out = mix(out * _JOIN + word[j : n + j])
    return out


def shingle_set(text: str, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles; a text of fewer words is one shingle, one of none has none."""
    w = words(text)
    if not len(w):
        return w
    if len(w) < k:
        return mix(runs(w, len(w)) + np.uint64(len(w)))
    return np.unique(runs(w, k))
