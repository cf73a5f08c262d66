"""Periodic runs of words, by Kruskal's order over suffix classes.

A run is a stretch of consecutive words with smallest period q, of length 2 * q and ``least`` or more, that no neighbouring word extends. For each text:

1. Words are numbered. A run of length L and period q gives two suffixes, at its start and q words on, whose longest common prefix (LCP) is L - q, half of L or more;
   so only places matter whose next least / 2 words come again in the text. Most texts have none.
2. The suffixes at these places are sorted by prefix doubling; the numbers of each round give the LCPs of neighbours.
3. Classes of suffixes are united by decreasing LCP (union-find, the smaller into the larger, each with its places in order). Two places
   that become neighbours in a class at LCP l have exactly that LCP. At a distance d of l or less they seed a stretch of period d and length l + d; it is a run if the
   words before both differ. A run's first two places become neighbours just so, as a place between them would have a smaller period; of equal stretches the smallest period is kept.

Each text is a row by itself and is read whole; nothing is exact by probability only.

Defined results: null, empty and blank texts have no runs and an empty collapsed text. Texts are compared as bytes, words may be of any length. Repeated rows and ids, null ids and empty tables
make no difference. Other columns go along as they are; those of the result's names (runs, collapsed) are replaced.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cloudloom.llm.common import slices

LEAST = 12
_MIX = np.random.default_rng(20240913).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _again(ids: np.ndarray, k: int) -> bool:
    """Whether any k words in a row may come twice; never wrongly no."""
    n = len(ids) - k + 1
    if n < 2:
        return False
    with np.errstate(over="ignore"):
        own = ids.astype(np.uint64) * _MIX[-1]
        own ^= own >> np.uint64(29)
        grams = np.zeros(n, np.uint64)
        for j in range(k):
            grams = (grams + own[j : j + n]) * _MIX[j % (len(_MIX) - 1)]
    grams.sort()
    return bool((grams[1:] == grams[:-1]).any())


def _numbered(key: np.ndarray) -> np.ndarray:
    """For each place how many places have a smaller key."""
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    out = np.empty(len(key), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return out


class Suffixes:
    """The suffixes of a sequence (numbers from 1) that share k words or more with another one, sorted so that those with a common prefix stand together, and the LCPs of neighbours."""

    def __init__(self, ids: np.ndarray, k: int):
        self.n = len(ids)
        self.ranks = {1: _numbered(ids)}
        width = 1
        while width < k:
            step = min(width, k - width)
            self.ranks[width + step] = _numbered(self._pairs(self.ranks[width], step))
            width += step
        rank = self.ranks[k]
        active = np.flatnonzero(np.bincount(rank, minlength=self.n)[rank] > 1)
        self.places = active
        while len(active):
            key = self._pairs(rank, width, active)
            order = np.argsort(key, kind="stable")
            at, key = active[order], key[order]
            index = np.arange(len(at))
            old = np.concatenate([[True], rank[at][1:] != rank[at][:-1]])
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank = rank.copy()
            rank[at] += np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(old, index, 0))
            width *= 2
            self.ranks[width] = rank
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(at)))
            active = np.sort(at[np.repeat(sizes > 1, sizes)])
        self.places = self.places[np.argsort(rank[self.places], kind="stable")]

    def _pairs(self, rank: np.ndarray, step: int, at: np.ndarray | None = None) -> np.ndarray:
        """A number for each place that tells its rank and that of the place step words on; 0 beyond the end."""
        at = np.arange(self.n) if at is None else at
        beyond = np.append(rank + 1, 0)
        return rank[at] * (self.n + 2) + beyond[np.minimum(at + step, self.n)]

    def common(self) -> np.ndarray:
        """The LCP of each suffix with the next."""
        a, b = self.places[:-1].copy(), self.places[1:].copy()
        out = np.zeros(len(a), np.int64)
        for width in sorted(self.ranks, reverse=True):
            # Unequal places never have equal ranks at a width that reaches over the end.
            rank = np.append(self.ranks[width], [-1])
            inside = np.maximum(a, b) < self.n
            same = inside & (rank[np.minimum(a, self.n)] == rank[np.minimum(b, self.n)])
            a, b, out = a + width * same, b + width * same, out + width * same
        return out


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers from 1, by start, then period."""
    k = -(-least // 2)
    if len(ids) < least or not _again(ids, k):
        return []
    suffixes = Suffixes(ids, k)
    common = suffixes.common()
    edges = np.flatnonzero(common >= k)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    words = ids.tolist()
    held: list[list[int]] = [[p] for p in suffixes.places.tolist()]
    above = list(range(len(held)))
    found: dict[tuple[int, int], int] = {}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for edge, shared in zip(edges.tolist(), common[edges].tolist(), strict=True):
        small, large = top(edge), top(edge + 1)
        if len(held[small]) > len(held[large]):
            small, large = large, small
        into, last = held[large], -1
        for x in held[small]:
            at = bisect(into, x)
            near = []
            if at and into[at - 1] != last:
                near.append((into[at - 1], x))
            if at < len(into):
                near.append((x, into[at]))
            for i, j in near:
                d = j - i
                if d <= shared and d + shared >= least and (not i or words[i - 1] != words[j - 1]):
                    key = (i, d + shared)
                    found[key] = min(d, found.get(key, d))
            into.insert(at, x)
            last = x
        held[small] = []
        above[small] = large
    return sorted((start, length, period) for (start, length), period in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, with single spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def scan(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with runs, an array of (start, length, period) in words by start, then period, and collapsed, the text in which each run is left with its first period."""
    docs = docs.drop("runs", "collapsed")
    runs_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([*docs.schema.fields, T.StructField("runs", runs_type), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                flat, sizes, texts = [], [0], []
                for own in part.column(text).cast(pa.binary()).to_pylist():
                    words = own.split() if own else []  # bytes split at space and U+0009 to U+000D
                    found = []
                    if len(words) >= least:
                        number = defaultdict(count(1).__next__)
                        found = runs_of(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), least)
                    flat += found
                    sizes.append(len(flat))
                    texts.append(collapsed(words, found))
                columns = np.array(flat, np.int64).reshape(-1, 3).T
                structs = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs), pa.array(texts, pa.binary()).view(pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)
