"""Sets of hashed word shingles.

A text is lower-cased (A-Z); words are what stands between space and U+0009 to U+000D. Its set holds the 64-bit hashes of its
distinct shingles of five words; of one to four words, that of the whole sequence; without words it is empty. Hashes are keyed sums of
mixed numbers: two given shingles share one with probability 2**-64, unless a text was made with the keys in mind.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
#: Texts are hashed in pieces of about this many bytes.
PIECE = 1 << 18

_KEYS = np.random.default_rng(20240601).integers(1, 2**63, SIZE + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES, _LETTER, _PLACE = _KEYS[:SIZE], _KEYS[SIZE], _KEYS[SIZE + 1]
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of a piece that is cut at separators.

    A word's hash is the sum of a mixed number for each of its bytes and their places in it, mixed once more with its length.
    """
    raw = np.frombuffer(piece, np.uint8)
    inside = np.concatenate([[False], ~_SEPARATOR[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    ends = np.cumsum(sizes)
    places = np.arange(int(ends[-1]), dtype=np.uint64) - np.repeat(ends - sizes, sizes).astype(np.uint64)
    letters = mixed(_LOWER[raw[inside[1:-1]]] * _LETTER + places * _PLACE)
    return mixed(np.add.reduceat(letters, ends - sizes) + sizes.astype(np.uint64) * _LETTER), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text)."""
    buffer = b"\n".join(texts)
    hashes, starts, at = [], [], 0
    while at < len(buffer):
        end = at + PIECE
        if end < len(buffer):  # go on to the next separator
            while end < len(buffer) and not _SEPARATOR[buffer[end]]:
                end += 1
        h, s = _words(buffer[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    of = np.searchsorted(begins, np.concatenate(starts), side="right") - 1
    return np.concatenate(hashes), np.bincount(of, minlength=len(texts))


def sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted set of each text."""
    words, counts = word_hashes([t.encode() if t else b"" for t in texts])
    with np.errstate(over="ignore"):
        n = max(0, len(words) - SIZE + 1)
        grams = np.zeros(n, np.uint64)
        for k in range(SIZE):
            grams += words[k : k + n] * _PLACES[k]
        grams = mixed(grams)
        out, at = [], 0
        for count in counts.tolist():
            if count >= SIZE:
                out.append(np.unique(grams[at : at + count - SIZE + 1]))
            elif count:
                out.append(mixed(np.array([np.uint64(count) + np.sum(words[at : at + count] * _PLACES[:count], dtype=np.uint64)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += count
    return out


def digest(own: np.ndarray) -> int:
    """64 bits that equal sets share."""
    with np.errstate(over="ignore"):
        return int(np.sum(mixed(own * np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64).view(np.int64))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
