"""Spelling variant grouping by a trie over frequency vectors.

Words are near if they differ by exactly one inserted, deleted or replaced letter (code point). A word's form is its near word that occurs most, if that occurs so many times as often;
its root is where the forms of forms end.

1. A word's frequency vector counts its letters group by group: a group holds one letter of the Latin alphabet and some accented ones, and the frequent
   letters come first. One edit makes one count larger by one, or one smaller, or both: a surplus and a deficit of one each.
2. The words form a trie by their counts, one group a level. It is dealt out by nodes, of a depth that follows from the number of words: a node's task holds the words below it and those below greater nodes
   within the budget; nodes whose task would hold more than MOST go down another level.
3. A task searches its trie against itself and against its neighbours', depth first, spending the surplus and the deficit; pairs of words at the leaves are verified:
   their common beginning and end cover all but the edited letter. Each pair is met in one task, so what tasks count and find largest only has to be added up; pairs aren't rows.
4. Roots are found by doubling the way along forms, which always lead to more frequent words.

``counts`` takes the words from texts: maximal runs of letters of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased.

Defined results: null, empty and letterless texts have no words. Words of any length are compared whole. Repeated rows count again. With a null id no letter is dropped. Ties go to the word that is first in code-point order.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm.common import Workspace, lookup, saved, slices
from cloudloom.llm.tries import Trie, meeting

LETTERS = "A-Za-zÀ-ÿ"
#: The letters by which groups are made, the most frequent first.
ORDER = "eniratsoduhlcgmbfwkzpvyjxq"
#: Words of a node when the trie is dealt out, the most that one task's search may hold before its node is parted, and distinct words that a task counts at once.
NODE, MOST, COUNTED = 1 << 13, 1 << 16, 1 << 18
#: Letters of a word that are compared at once; longer words are compared one by one.
WIDE = 64
_GROUP = np.array([ORDER.index(chr(97 + (c - 97) % 26)) for c in range(256)], np.int64)
_LOWER = {c: c + 32 for c in range(65, 91)}


def counts(docs: DataFrame, id_: str = "doc_id", text: str = "text", least_letters: int = 6, least: int = 5, every: int = 0) -> DataFrame:
    """(word, n): how often each word occurs, of those with least_letters or more that occur least times or more.

    every: of a word's occurrences in a document, where the crc32 of "id:word" is a multiple of it, the letter at the place crc32 % length is dropped first. 0: none is.
    """
    keyed = docs.select(F.col(id_).cast("string").alias("id"), F.col(text).alias("text"))
    pattern = re.compile(f"[{LETTERS}]{{{max(1, least_letters)},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                for id_, own in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    before = None if id_ is None or not every else zlib.crc32(f"{id_}:".encode())
                    for word, n in Counter(pattern.findall(own or "")).items():
                        word = word.lower() if word.isascii() else word.translate(_LOWER)
                        if before is not None:
                            crc = zlib.crc32(word.encode(), before)
                            if crc % every == 0:
                                cut = crc % len(word)
                                word = word[:cut] + word[cut + 1 :]
                        held[word] += n
                    if len(held) >= COUNTED:
                        yield given()
                        held.clear()
        yield given()

    found = keyed.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= least) & (F.length("word") >= least_letters))


def frequencies(words: list[str]) -> np.ndarray:
    """A row for each word: how many letters of each group it has."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * len(ORDER) + _GROUP[flat], minlength=len(words) * len(ORDER)).reshape(len(words), len(ORDER))


def moves(levels: int) -> list[np.ndarray]:
    """What the budget may add to the counts of so many levels: nothing, one letter more, one less, or both."""
    one = np.eye(levels, dtype=np.int64)
    return [np.zeros(levels, np.int64), *one, *-one, *[one[i] - one[j] for i in range(levels) for j in range(levels) if i != j]]


def _lower(rows: DataFrame, depth: int, to: int, only_own: bool = False) -> DataFrame:
    """rows (word, n, node, own) at nodes of depth (two bytes for each count so far), dealt to the nodes of the level to: to their own, and (unless only_own) to smaller ones within the budget; own says which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = frequencies(batch.column("word").to_pylist())[:, :to]
            node = np.frombuffer(b"".join(batch.column("node").to_pylist()), ">u2").reshape(len(path), depth).astype(np.int64)
            own = batch.column("own").to_numpy(zero_copy_only=False)
            apart = node - path[:, :depth]
            up, down = (apart > 0).sum(axis=1), (apart < 0).sum(axis=1)
            for move in moves(to - depth)[: 1 if only_own else None]:
                target = path[:, depth:] + move
                good = (target >= 0).all(axis=1) & (up + (move > 0).any() <= 1) & (down + (move < 0).any() <= 1)
                if move.any() and move[move != 0][0] > 0:
                    good &= ~own  # leads to a greater node
                at = np.flatnonzero(good)
                if len(at):
                    there = np.concatenate([node[at], target[at]], axis=1).astype(">u2").tobytes()
                    names = pa.Array.from_buffers(pa.binary(2 * to), len(at), [None, pa.py_buffer(there)]).cast(pa.binary())
                    taken = pa.array(at)
                    yield pa.RecordBatch.from_arrays([batch.column("word").take(taken), batch.column("n").take(taken), names, pa.array(own[at] & (not move.any()))], names=["word", "n", "node", "own"])

    return rows.select("word", "n", "node", "own").mapInArrow(run, "word string, n long, node binary, own boolean")


def _dealt(rows: DataFrame, depth: int, to: int, work: Workspace) -> DataFrame:
    """rows at the nodes of the level to, without those sent to nodes that no word lies in. Written."""
    nodes = work.keep(_lower(rows.where("own"), depth, to, True).select("node").distinct())
    return work.keep(_lower(rows, depth, to).join(lookup(nodes), "node", "left_semi"))


def fits(level: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    return (up <= 1) & (down <= 1)


class Words:
    """Words as matrices: letters from the left and from the right, and the counts of their groups."""

    def __init__(self, words: list[str]):
        self.words, n = words, len(words)
        self.sizes = np.array([len(w) for w in words], np.int64)
        wide = int(min(WIDE, self.sizes.max(initial=1)))
        flat = np.frombuffer("".join(w[:wide] for w in words).encode("latin-1"), np.uint8)
        ends = np.frombuffer("".join(w[-wide:][::-1] for w in words).encode("latin-1"), np.uint8)
        row, place = np.repeat(np.arange(n), np.minimum(self.sizes, wide)), np.concatenate([np.arange(min(s, wide)) for s in self.sizes.tolist()] or [np.zeros(0, np.int64)])
        self.left, self.right = np.zeros((2, n, wide + 1), np.uint8)
        self.left[row, place], self.right[row, place] = flat, ends
        self.counts = frequencies(words)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether exactly one edit leads from word i to word j; the words differ."""
        short, long = np.minimum(self.sizes[i], self.sizes[j]), np.maximum(self.sizes[i], self.sizes[j])
        begin = (self.left[i] != self.left[j]).argmax(axis=1)
        end = (self.right[i] != self.right[j]).argmax(axis=1)
        good = (long - short <= 1) & (np.where(short == long, short - 1, short) <= begin + end)
        for k in np.flatnonzero((long > WIDE) & (long - short <= 1)).tolist():
            a, b = sorted((self.words[i[k]], self.words[j[k]]), key=len)
            at = next((p for p, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
            good[k] = a[at + (len(a) == len(b)) :] == b[at + 1 :]
        return good


def searched(words: list[str], n: np.ndarray, own: np.ndarray) -> pa.Table:
    """(word, n_near, best: the largest n among the near words, form: the first word that has it) of the words that have a near one: between those of a node (own), and between these and the others."""
    order = pc.sort_indices(pa.array(words)).to_numpy()  # by bytes, which is the order of code points
    words, n, own = [words[i] for i in order.tolist()], n[order], own[order]
    known = Words(words)
    order = np.lexsort((*known.counts.T[::-1], ~own))
    split = int(own.sum())
    here, there = order[:split], order[split:]
    tries = Trie(known.counts[here]), Trie(known.counts[there])
    total, best, form = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for other, rows in ((None, here), (tries[1], there)):
        for i, j in meeting(tries[0], other, fits):
            i, j = here[i], rows[j]
            near = known.near(i, j)
            who, by = np.concatenate([i[near], j[near]]), np.concatenate([j[near], i[near]])
            total += np.bincount(who, minlength=len(words))
            ranked = np.lexsort((by, -n[by], who))
            who, by = who[ranked], by[ranked]
            first = np.concatenate([[True], who[1:] != who[:-1]])[: len(who)]
            who, by = who[first], by[first]
            better = (n[by] > best[who]) | ((n[by] == best[who]) & (by < form[who]))
            best[who[better]], form[who[better]] = n[by[better]], by[better]
    met = np.flatnonzero(total)
    return pa.table({"word": pa.array([words[i] for i in met.tolist()], pa.string()), "n_near": pa.array(total[met]), "best": pa.array(best[met]), "form": pa.array([words[i] for i in form[met].tolist()], pa.string())})


def neighbours(words: DataFrame, work: Workspace, node: int = NODE, most: int = MOST) -> DataFrame:
    """(word, n_near, best, form) of the words (word, n; distinct, written) that have a near one; best is the largest n among the near words, form the first word with it."""
    total = words.count()
    # Each level parts nodes in two or three, so about this many lead to nodes of the wished size; nodes that are still crowded go on.
    depth = min(len(ORDER), max(0, math.ceil(math.log(max(1.0, total / node / 3)) / math.log(2.3)))) if total > node else 0
    rows = words.select("word", "n", F.lit(b"").alias("node"), F.lit(True).alias("own"))
    rows, parts = _dealt(rows, 0, depth, work) if depth else rows, []
    while True:
        crowded = work.keep(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most).select("node"))
        if depth >= len(ORDER) or crowded.isEmpty():
            parts.append(rows)
            break
        few = lookup(crowded)
        parts.append(rows.join(few, "node", "left_anti"))
        rows = _dealt(rows.join(few, "node", "left_semi"), depth, depth + 1, work)
        depth += 1

    def search(table: pa.Table) -> pa.Table:
        return searched(table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("own").to_numpy())

    dealt = parts[0].select("node", "word", "n", "own")
    for more in parts[1:]:
        dealt = dealt.unionByName(more.select("node", "word", "n", "own"))
    found = dealt.groupBy("node").applyInArrow(search, "word string, n_near long, best long, form string")
    top = F.min(F.struct((-F.col("best")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select("word", "n_near", (-F.col("top.less")).alias("best"), "top.form")


def group(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of the distinct words (word, n)."""
    with Workspace(words.sparkSession) as work:
        words = work.keep(words.select("word", "n"))
        near = work.keep(words.join(neighbours(words, work), "word", "left").withColumn("has", F.col("best") >= times * F.col("n")))
        named = near.select("word", F.when(F.col("has"), F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("has"), F.col("best")).alias("form_n"))
        way = work.keep(named.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
        while True:
            further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
            way = work.keep(way.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            if way.where("moved").isEmpty():
                break
            way = way.drop("moved")
        out = named.join(way.select("word", "root"), "word", "left")
        return saved(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
