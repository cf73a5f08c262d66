"""SimHash near-dedup by a self-join of binary tries.

A text's fingerprint has 64 bits: bit i is 1 if it is set in over half of the hashes (XXH64, seed 42) of the text's shingles of three words, repeats included. Texts link when
their fingerprints differ in three bits or less.

1. Equal fingerprints collapse; what follows is one row for each.
2. Of two linked fingerprints the upper or the lower half differs in one bit at most. So there are two tries, one with each half on top, walked with a budget of one bit
   in the first 32 levels and of three in all; near the root almost nothing but a node and itself stays within it.
3. The tries are dealt out by nodes: a node's task holds the fingerprints below it and those below greater nodes within the budget. The depth
   follows from the number of fingerprints, so that a node has about NODE; nodes whose task would hold more than MOST go down further levels, as often as needed.
4. A task walks its trie against itself and against its neighbours', node pair by node pair, adding up the bits that differ and leaving a pair once the budget is exceeded.
   Of the links it finds it keeps those that join components which were still apart, so a task gives fewer rows than it holds fingerprints, however large a family is.
5. Components give each fingerprint the smallest id.

Defined results: null, empty and blank texts have fingerprint 0, which links like any other. Ids may be of any type that has an order; rows of equal id and different text are documents of their own; a component
without any id has a null component_id. Texts of any length are read whole. An empty table gives an empty result. Extra columns are ignored by ``cluster``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm.common import Workspace, lookup, saved, slices
from cloudloom.llm.tries import Trie, meeting
from cloudloom.operators.clusters import components

WORDS, SEED, BUDGET, HALF = 3, 42, 3, 32
#: Fingerprints of a node, and the most that one task's walk may hold before its node is parted.
NODE, MOST = 1 << 10, 1 << 15
#: Levels that a crowded node goes down at once.
STEP = 4


def hashes(text: bytes | None) -> np.ndarray:
    """The hash of each shingle of a text."""
    words = text.lower().split() if text else []  # A-Z only; split at space and U+0009 to U+000D
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]])
    ends = ends[-n:] - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64, n)


def fingerprint(own: np.ndarray) -> int:
    """Bits that over half of the hashes have, as a signed number."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(own), 1 << 14):  # long texts in parts
        counts += np.unpackbits(own[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(own), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) of each row."""
    keyed = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([keyed.schema.fields[0], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = [fingerprint(hashes(x)) for x in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.int64())], names=schema.names)

    return keyed.mapInArrow(run, schema)


def _number(bits: list[int]) -> int:
    """A 64-bit mask as the signed number that Spark has for it."""
    n = sum(1 << b for b in bits)
    return n - (1 << 64) if n >= 1 << 63 else n


def _lower(rows: DataFrame, depth: int, step: int) -> DataFrame:
    """rows (half, fp, bits, node, own) at nodes of depth, dealt to the nodes step levels on: to their own, and to smaller ones within the budget; own says which."""
    limit = 1 if depth + step <= HALF else BUDGET
    masks = [0, *[_number([i]) for i in range(step)]]
    if limit > 1:
        masks += [_number([i, j]) for i in range(step) for j in range(i)] + [_number([i, j, k]) for i in range(step) for j in range(i) for k in range(j)]
    path = lambda d: F.shiftrightunsigned("bits", 64 - d) if d else F.lit(0).cast("long")
    spent = F.bit_count(path(depth).bitwiseXOR(F.col("node")))
    moved = rows.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).where(spent + F.bit_count("mask") <= limit)
    to = F.shiftleft("node", step).bitwiseOR(path(depth + step).bitwiseXOR(F.col("mask")).bitwiseAND(F.lit(_number(list(range(step))))))
    # Numbers of 64 bits are compared with their sign, which is an order like another.
    target = moved.withColumn("to", to).where(~F.col("own") | (F.col("mask") == 0) | (F.col("to") < path(depth + step)))
    return target.select("half", "fp", "bits", F.col("to").alias("node"), (F.col("own") & (F.col("mask") == 0)).alias("own"))


class Forest:
    """Components of numbered rows, joined inside one task."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def joined(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        """Of the links (a, b) those that join what was apart."""
        apart = self.root[a] != self.root[b]
        a, b = a[apart], b[apart]
        kept: tuple[list[int], list[int]] = ([], [])
        while len(a):
            # Each root takes the first link to a smaller one; what these leave apart comes again.
            x, y = self.root[a], self.root[b]
            high, low = np.maximum(x, y), np.minimum(x, y)
            roots, first = np.unique(high, return_index=True)
            kept[0].extend(a[first].tolist())
            kept[1].extend(b[first].tolist())
            self.root[roots] = low[first]
            while True:
                further = self.root[self.root]
                if (further == self.root).all():
                    break
                self.root = further
            apart = self.root[a] != self.root[b]
            a, b = a[apart], b[apart]
        return kept


def bits_of(numbers: np.ndarray) -> np.ndarray:
    """The 64 bits of each number, the highest first."""
    return np.unpackbits(numbers.view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def fits(level: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    return up + down <= (1 if level <= HALF else BUDGET)


def linked(fps: np.ndarray, bits: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the fingerprints of a node (own) and between these and the other ones; bits has the order of the trie."""
    order = np.lexsort((bits.view(np.uint64), ~own))
    fps, bits, n = fps[order], bits[order], int(own.sum())
    here = Trie(bits_of(bits[:n]))
    forest, links = Forest(len(fps)), ([], [])
    for other, shift in ((None, 0), (Trie(bits_of(bits[n:])), n)):
        for i, j in meeting(here, other, fits):
            j = j + shift
            near = np.bitwise_count((fps[i] ^ fps[j]).view(np.uint64)) <= BUDGET
            for side, found in zip(links, forest.joined(i[near], j[near]), strict=True):
                side.extend(found)
    return fps[links[0]], fps[links[1]]


def links(fps: DataFrame, work: Workspace, node: int = NODE, most: int = MOST) -> DataFrame:
    """Links (a, b) between different fingerprints (fp) that join all which are linked."""
    depth = min(HALF, max(0, math.ceil(math.log2(max(1, fps.count()) / node))))
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("fp").alias("bits")), F.struct(F.lit(1).alias("half"), swapped().alias("bits"))))
    rows = fps.select("fp", halves.alias("one")).select("one.half", "fp", "one.bits", F.lit(0).cast("long").alias("node"), F.lit(True).alias("own"))
    rows, parts = _lower(rows, 0, depth), []
    while True:
        crowded = work.keep(rows.groupBy("half", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("half", "node"))
        if depth >= 64 or crowded.isEmpty():
            parts.append(rows)
            break
        few = lookup(crowded)
        parts.append(rows.join(few, ["half", "node"], "left_anti"))
        step = min(STEP, HALF - depth if depth < HALF else 64 - depth)
        rows = work.keep(_lower(rows.join(few, ["half", "node"], "left_semi"), depth, step))
        depth += step
        rows = rows.join(lookup(work.keep(rows.where("own").select("half", "node").distinct())), ["half", "node"], "left_semi")

    def walk(table: pa.Table) -> pa.Table:
        a, b = linked(*[table.column(c).to_numpy() for c in ("fp", "bits", "own")])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = parts[0]
    for more in parts[1:]:
        dealt = dealt.unionByName(more)
    return dealt.groupBy("half", "node").applyInArrow(walk, "a long, b long")


def swapped() -> Column:
    """fp with its halves exchanged."""
    return F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", HALF))


def cluster(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id_, fingerprint (16 lowercase hex digits), component_id for each row of docs."""
    with Workspace(docs.sparkSession) as work:
        rows = work.keep(fingerprints(docs, id_, text))
        classes = work.keep(rows.groupBy("fp").agg(F.min("id").alias("id")))
        found = components(links(classes.select("fp"), work), work).withColumnRenamed("node", "fp")
        met = work.keep(found.join(classes, "fp"))
        least = work.keep(met.groupBy("root").agg(F.min("id").alias("least")))
        named = met.join(lookup(least), "root").select("fp", "least", F.lit(True).alias("linked"))
        # A component may have no id, so a null one doesn't say that a class is alone.
        every = work.keep(classes.join(named, "fp", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("id")).alias("component")))
        hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0"))
        return saved(rows.join(lookup(every), "fp").select(F.col("id").alias(id_), hex_.alias("fingerprint"), F.col("component").alias("component_id")))
