"""Unigram lattices over a public piece vocabulary: count-only Viterbi, and sampled segmentation with lossless decoding.

The vocabulary file holds pieces with scores; they are read as a unigram model: a segmentation's score is the sum of its
pieces' scores. A space is written as U+2581 and one stands before the text. A character that no single-character piece
covers may also stand alone, at the lowest score less 10, and is written as its UTF-8 bytes.

No piece goes on over a U+2581 that follows another character, so the best (or sampled) segmentation of a text is that of its
chunks, one for each word with the spaces before it. A line feed is in no piece and is a chunk of its own. Vocabularies that
break this rule are refused. Of the chunks of a few megabytes of text each different one is matched once; the dynamic programs then
step through the ends of all of them together, character by character.

Exact tie rule: ends are reached from the earliest start first, and a later start must be strictly better, so of equal
scores the longer last piece wins. Scores are summed in 64-bit floats, in which sums of this vocabulary's whole numbers are exact;
a tokenizer that sums in 32 bits agrees as long as all its scores and sums stay below 2**24 (the file's runs of spaces, at -1e9,
don't: with them among its scores the library rounds every comparison).

Defined results: a null text gives a count of 0 and a null list of pieces, an empty text 0 and an empty list. Texts of any length are cut
into chunks first; a chunk without spaces is walked once, in memory proportional to its length. Repeated rows give equal
results, as the seed comes from the row's key alone (a null key counts as 0, one that is no whole number as its digest), and neither the other rows of
a task nor the order in which chunks are met change a result. Extra columns pass through; columns named like the output
are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, inf, log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm.common import slices, unused, vocabulary_file

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks of up to so many characters are walked together, those of a slice of texts at once; longer ones one by one.
LONGEST = 64
#: Different chunks that a worker remembers before it starts anew.
MOST_KNOWN = 200_000
#: Places in the filtered lattices that a worker remembers before it starts anew; one takes about 50 bytes.
MOST_PLACES = 1 << 20
#: Bytes of text that are sampled together, new chunks that are filtered together, and chunks whose segmentations are drawn together.
SAMPLED_BYTES, FILTERED_CHUNKS, DRAWN = 1 << 19, 1 << 13, 1 << 16
CHUNKS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
GOLDEN = 0x9E3779B97F4A7C15


@dataclass
class Vocabulary:
    pieces: list[tuple[str, float, int]]  # ordinary pieces: text, score, id
    bytes_: list[int]  # id of each byte's piece
    surfaces: dict[int, bytes]


def load(path: str | None = None) -> Vocabulary:
    """The vocabulary of a sentencepiece file with byte pieces and the identity normalizer."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path or vocabulary_file("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    return of_model(model)


def of_model(model) -> Vocabulary:
    rules, kinds = model.normalizer_spec, model.SentencePiece
    if rules.name != "identity" or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
        raise ValueError("only the identity normalizer with a leading space and byte fallback is supported")
    pieces = [(p.piece, p.score, i) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
    if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p, _, _ in pieces):
        raise ValueError("a piece goes on over a word's end")
    bytes_ = [i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE]
    surfaces = {i: p.replace(SPACE, " ").encode() for p, _, i in pieces} | {i: bytes([int(model.pieces[i].piece[3:5], 16)]) for i in bytes_}
    return Vocabulary(pieces, sorted(bytes_, key=lambda i: surfaces[i]), surfaces)


def shared_vocabulary(spark: SparkSession, vocabulary: Vocabulary):
    """A broadcast, as large as the vocabulary's file, of plain tuples: workers that have no copy of this package can read it."""
    return spark.sparkContext.broadcast((vocabulary.pieces, vocabulary.bytes_, vocabulary.surfaces))


class Lattice:
    """The segmentations of chunks: an Aho-Corasick automaton lists the pieces that end at each character."""

    def __init__(self, vocabulary: Vocabulary, alpha: float = 1e-3):
        self.bytes_, self.alpha = vocabulary.bytes_, alpha
        self.unknown = min(s for _, s, _ in vocabulary.pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score, id_ in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score, array("i", [id_])))
        self.automaton.make_automaton()
        self.scores, self.ids = np.array([s for _, s, _ in vocabulary.pieces], float), np.array([i for *_, i in vocabulary.pieces], np.int64)
        self.pieces = [p for p, _, _ in vocabulary.pieces]
        self.packed = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, (piece, _, _) in enumerate(vocabulary.pieces):
            self.packed.add_word(piece, len(piece) << 20 | k)
        self.packed.make_automaton()

    def ends(self, chunk: str) -> Iterator[tuple[int, list[tuple[int, float, array]]]]:
        """For each end, the (start, score, ids) of the pieces that end there, earliest start first."""
        found = self.automaton.iter(chunk)
        at, piece = next(found, (inf, None))
        for i in range(len(chunk)):
            here = []
            while at == i:
                here.append((i + 1 - piece[0], piece[1], piece[2]))
                at, piece = next(found, (inf, None))
            if not here or here[-1][0] != i:
                here.append((i, self.unknown, array("i", [self.bytes_[b] for b in chunk[i].encode()])))
            yield i + 1, here

    def count(self, chunk: str) -> tuple[int, float]:
        """Piece count and score of the best segmentation; only these two are carried along."""
        best, counts = [0.0] * (len(chunk) + 1), [0] * (len(chunk) + 1)
        for end, here in self.ends(chunk):
            top, n = -inf, 0
            for start, score, ids in here:
                if best[start] + score > top:
                    top, n = best[start] + score, counts[start] + len(ids)
            best[end], counts[end] = top, n
        return counts[-1], best[-1]

    def forward(self, chunk: str) -> list[list[tuple[float, int, array]]]:
        """For each end, (cumulated probability, start, ids) of its pieces, by forward filtering."""
        total, steps = [0.0] * (len(chunk) + 1), [[] for _ in range(len(chunk) + 1)]
        for end, here in self.ends(chunk):
            logs = [total[start] + self.alpha * score for start, score, _ in here]
            top = max(logs)
            weights = [exp(x - top) for x in logs]
            mass, run = sum(weights), 0.0
            total[end] = top + log(mass)
            for (start, _, ids), w in zip(here, weights, strict=True):
                if w:
                    run += w / mass
                    steps[end].append((run, start, ids))
        return steps

    def backward(self, steps: list, draws: Iterator[float]) -> array:
        """A segmentation drawn from the end backwards, a random number for each piece."""
        at, parts = len(steps) - 1, []
        while at:
            u = next(draws)
            for upto, start, ids in steps[at]:
                if u < upto:
                    break
            at = start
            parts.append(ids)
        out = array("i")
        for ids in reversed(parts):
            out.extend(ids)
        return out


def chunks(text: str) -> Iterator[tuple[str, bool]]:
    """(chunk, False) in order, and (U+2581, True) for one that stands in the text itself, which is written as bytes."""
    for k, part in enumerate((" " + text).split(SPACE)):
        if k:
            yield SPACE, True
        for c in CHUNKS.findall(part.replace(" ", SPACE)):
            yield c, False


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(key: int, seed: int, n: int, after: int = 0) -> list[float]:
    """n numbers in [0, 1) that depend on key, seed and their place only."""
    base = mixed(np.array([(key ^ seed * GOLDEN) % 2**64], np.uint64))
    with np.errstate(over="ignore"):
        x = mixed(base + np.arange(after + 1, after + n + 1, dtype=np.uint64) * np.uint64(GOLDEN))
    return ((x >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()


class Trie:
    """The pieces' prefixes in an open-addressed table, so that many places of a text are followed at once."""

    BITS = 19

    def __init__(self, pieces: list[str]):
        known: dict[int, int] = {0: -1}
        for k, piece in enumerate(pieces):
            h = 0
            for c in piece:
                h = self.next(h, ord(c))
                known.setdefault(h, -1)
            known[h] = k
        del known[0]
        self.keys, self.values = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
        self.probes = 1
        for h, k in known.items():
            at, tries = h >> (64 - self.BITS), 1
            while self.keys[at]:
                at, tries = (at + 1) % (1 << self.BITS), tries + 1
            self.keys[at], self.values[at] = h, k
            self.probes = max(self.probes, tries)

    @staticmethod
    def next(h: int, code: int) -> int:
        x = ((h ^ code + 1) * GOLDEN) % 2**64
        return (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64 or 1

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, sizes, piece numbers) of all places where pieces stand, as the automaton finds them."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        start, hashes, size, out = np.arange(len(codes)), np.zeros(len(codes), np.uint64), 0, []
        with np.errstate(over="ignore"):
            while len(start):
                size += 1
                x = (hashes ^ codes[start + (size - 1)]) * np.uint64(GOLDEN)
                hashes = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                slot = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
                seen = self.keys[slot]
                for _ in range(self.probes - 1):
                    off = np.flatnonzero((seen != hashes) & (seen != 0))
                    if not len(off):
                        break
                    slot[off] = (slot[off] + 1) % (1 << self.BITS)
                    seen[off] = self.keys[slot[off]]
                good = np.flatnonzero(seen == hashes)
                start, hashes, value = start[good], hashes[good], self.values[slot[good]]
                piece = np.flatnonzero(value >= 0)
                out.append((start[piece] + size, np.full(len(piece), size), value[piece]))
                inside = start + size < len(codes)
                start, hashes = start[inside], hashes[inside]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


class Walk:
    """The lattices of many different chunks: every match of a piece, ordered by its end's place in its chunk, then chunk, then start.

    Boundaries are numbered through all chunks, which stand one after another with a line feed (in no piece) between them."""

    def __init__(self, lattice: Lattice, found: list[str], trie: Trie | None = None):
        text = "\n".join(found)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.begin = np.cumsum(sizes + 1) - (sizes + 1)
        self.end = self.begin + sizes
        if trie:
            end, size, kind = trie.matches(text)
        else:
            packed = np.fromiter((at << 32 | v for at, v in lattice.packed.iter(text)), np.int64)
            end, size, kind = (packed >> 32) + 1, packed >> 20 & 0xFFF, packed & 0xFFFFF
        # Characters that no piece covers alone get an entry of their own, after the longer pieces that end there.
        alone = np.ones(len(text), bool)
        alone[end[size == 1] - 1] = False
        alone[self.end[:-1]] = False
        extra = np.flatnonzero(alone) + 1
        self.codes = np.array([ord(text[i - 1]) for i in extra], np.int64)
        end, start = np.concatenate([end, extra]), np.concatenate([end - size, extra - 1])
        kind = np.concatenate([kind, len(lattice.scores) + np.arange(len(extra))])
        place = end - np.repeat(self.begin, sizes + 1)[end - 1] if len(end) else end
        order = np.argsort(place << 48 | end << 8 | (255 - (end - start)))
        self.stop, self.start, self.kind = end[order], start[order], kind[order]
        place = place[order]
        self.score = np.concatenate([lattice.scores, np.full(len(extra), lattice.unknown)])[self.kind]
        self.groups = np.flatnonzero(np.diff(self.stop, prepend=-1))
        #: Where the groups of each place begin.
        self.steps = np.searchsorted(place[self.groups], np.arange(1, int(sizes.max(initial=0)) + 2))
        self.length = len(text) + 1

    def each(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """For each place in turn: its matches, where each end's group begins among them, the groups' sizes and ends."""
        bounds = np.append(self.groups, len(self.stop))
        for low, high in zip(self.steps[:-1], self.steps[1:], strict=True):
            if low < high:
                own = bounds[low : high + 1]
                yield slice(own[0], own[-1]), own[:-1] - own[0], np.diff(own), self.stop[own[:-1]]

    def counts(self, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
        """Piece count and score of the best segmentation of each chunk."""
        pieces = np.ones(len(lattice.scores) + len(self.codes), np.int64)
        pieces[len(lattice.scores) :] = 1 + (self.codes > 0x7F) + (self.codes > 0x7FF) + (self.codes > 0xFFFF)
        best, count = np.zeros(self.length), np.zeros(self.length, np.int64)
        for own, begins, sizes, ends in self.each():
            start = self.start[own]
            total = best[start] + self.score[own]
            top = np.maximum.reduceat(total, begins)
            first = np.flatnonzero(total == np.repeat(top, sizes))
            group = np.repeat(np.arange(len(begins)), sizes)[first]
            first = first[np.flatnonzero(np.diff(group, prepend=-1))]  # of equal ones the earliest start
            best[ends], count[ends] = top, count[start[first]] + pieces[self.kind[own][first]]
        return count[self.end], best[self.end]

    def filter(self, alpha: float) -> None:
        """Forward filtering: the cumulated probabilities of the pieces of each end, from 0 to 1, summed inside the end's own group alone."""
        total, self.cumulated, self.group_of = np.zeros(self.length), np.empty(len(self.stop)), np.zeros(self.length, np.int64)
        number = 0
        for own, begins, sizes, ends in self.each():
            logs = total[self.start[own]] + alpha * self.score[own]
            top = np.maximum.reduceat(logs, begins)
            weight = np.exp(logs - np.repeat(top, sizes))
            for k in range(1, int(sizes.max())):
                at = begins[sizes > k] + k
                weight[at] += weight[at - 1]
            mass = weight[begins + sizes - 1]
            total[ends] = top + np.log(mass)
            self.cumulated[own] = weight / np.repeat(mass, sizes)
            self.group_of[ends] = number + np.arange(len(begins))
            number += len(begins)
        self.bounds = np.append(self.groups, len(self.stop))


class Filtered:
    """Filtered lattices of the chunks met so far, slice after slice."""

    def __init__(self):
        self.begin = self.end = self.group_of = self.start = self.kind = self.codes = np.zeros(0, np.int64)
        self.cumulated, self.bounds, self.chunks, self.length = np.zeros(0), np.zeros(1, np.int64), 0, 0

    def add(self, lattice: Lattice, found: list[str], trie: Trie) -> None:
        walk = Walk(lattice, found, trie)
        walk.filter(lattice.alpha)
        groups, n = len(self.bounds) - 1, len(lattice.scores)
        join = lambda old, new, kind: np.concatenate([old.astype(kind, copy=False), new.astype(kind)])
        self.begin, self.end = join(self.begin, walk.begin + self.length, np.int64), join(self.end, walk.end + self.length, np.int64)
        self.start = join(self.start, walk.start + self.length, np.int32)
        self.kind = join(self.kind, np.where(walk.kind >= n, walk.kind + len(self.codes), walk.kind), np.int32)
        self.group_of, self.cumulated = join(self.group_of, walk.group_of + groups, np.int32), join(self.cumulated, walk.cumulated, float)
        self.bounds = join(self.bounds[:-1], walk.bounds + self.bounds[-1], np.int64)
        self.codes = join(self.codes, walk.codes, np.int64)
        self.chunks += len(found)
        self.length += walk.length

    def sample(self, chunk: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of one segmentation for each entry of chunk: (kinds one after another, how many each has). keys: where each entry's random numbers start."""
        at, first = self.end[chunk].copy(), self.begin[chunk]
        active, step, parts = np.arange(len(chunk)), 0, []
        with np.errstate(over="ignore"):
            while len(active):
                u = (mixed(keys[active] + np.uint64((step + 1) * GOLDEN % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                group = self.group_of[at[active]].astype(np.int64)
                pick, high = self.bounds[group], self.bounds[group + 1] - 1
                while (pick < high).any():  # bisection inside each group
                    middle = (pick + high) >> 1
                    over = self.cumulated[middle] <= u
                    pick, high = np.where(over & (pick < high), middle + 1, pick), np.where(over, high, middle)
                parts.append((active, self.kind[pick]))
                at[active] = self.start[pick]
                active = active[at[active] > first[active]]
                step += 1
        n = np.zeros(len(chunk), np.int64)
        for who, _ in parts:
            n[who] += 1
        ends = np.cumsum(n)
        out = np.zeros(int(n.sum()), np.int32)
        for k, (who, kinds) in enumerate(parts):
            out[ends[who] - 1 - k] = kinds
        return out, n


class Chunks(dict):
    """Numbers of different chunks: from 0 for short ones, under 0 for a line feed, U+2581 and long chunks."""

    FEED, LITERAL = -1, -2

    def __init__(self):
        super().__init__()
        self.found: list[str] = []
        self.long: list[str] = []

    def __missing__(self, key: str) -> int:
        """Keys are words: one that follows a space as it is, others after a line feed."""
        chunk = key[1:] if key[:1] == "\n" else SPACE + key
        if len(chunk) > LONGEST:
            self.long.append(chunk)
            return -2 - len(self.long)
        self[key] = len(self.found)
        self.found.append(chunk)
        return self[key]

    def line(self, line: str, after: bool) -> list[int]:
        """The chunks of a line; after: whether a space stands before it."""
        if not line and not after:
            return []
        words = line.split(" ")
        if "" in words or SPACE in line:
            return [self["\n" + c] if c[0] != SPACE or len(c) > 1 and c[1] == SPACE else self[c[1:]] for c in CHUNKS.findall((SPACE if after else "") + line.replace(" ", SPACE))]
        return [*([self[words[0]]] if after else [self["\n" + words[0]]]), *map(self.__getitem__, words[1:])]

    def numbers(self, texts: list[str | None], literal: bool) -> tuple[np.ndarray, np.ndarray]:
        """(the chunks' numbers, one text after another; how many each text has)."""
        ids, counts = [], []
        for text in texts:
            before = len(ids)
            if text:
                whole = " " + text
                for k, part in enumerate(whole.split(SPACE) if literal and SPACE in whole else (whole,)):
                    if k:
                        ids.append(self.LITERAL)
                    for m, line in enumerate(part.split("\n")):
                        if m:
                            ids.append(self.FEED)
                        ids.extend(self.line(line[1:], True) if line[:1] == " " and not k | m else self.line(line, False))
            counts.append(len(ids) - before)
        return np.array(ids, np.int64), np.array(counts, np.int64)


class Sampler:
    """Sampled segmentations of slices of texts."""

    def __init__(self, lattice: Lattice, seed: int):
        self.lattice, self.seed, self.trie = lattice, seed, Trie(lattice.pieces)
        self.known, self.filtered = Chunks(), Filtered()
        self.literal = np.array([lattice.bytes_[b] for b in SPACE.encode()], np.int32)

    def encode_all(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all texts one after another, how many each has)."""
        if len(self.known) > MOST_KNOWN or self.filtered.length > MOST_PLACES:
            self.known, self.filtered = Chunks(), Filtered()
        known, walk = self.known, self.filtered
        ids, counts = known.numbers(texts, literal=True)
        while len(known.found) > walk.chunks:
            walk.add(self.lattice, known.found[walk.chunks : walk.chunks + FILTERED_CHUNKS], self.trie)
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        with np.errstate(over="ignore"):
            base = mixed(np.array([(k ^ self.seed * GOLDEN) % 2**64 for k in keys], np.uint64))
            inside = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = mixed(np.repeat(base, counts) + (inside + 1).astype(np.uint64) * np.uint64(GOLDEN))
        sizes = np.ones(len(ids), np.int64)
        special: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(ids < Chunks.FEED).tolist():
            special[i] = self.literal if ids[i] == Chunks.LITERAL else self.long(known.long[-3 - int(ids[i])], int(starts[i]))
            sizes[i] = len(special[i])
        # Sorted by chunk, so that what is looked up lies together.
        short, codes = np.argsort(ids, kind="stable")[int((ids < 0).sum()) :], np.zeros(0, np.int64)
        known.long.clear()
        if len(short):
            drawn = [walk.sample(ids[some], starts[some]) for some in np.split(short, range(DRAWN, len(short), DRAWN))]
            kinds, n = (np.concatenate(x) for x in zip(*drawn, strict=True))
            sizes[short], codes = n, walk.codes
        ends = np.cumsum(sizes)
        flat = np.full(int(sizes.sum()), self.lattice.bytes_[10], np.int32)
        if len(short):
            at = np.arange(len(kinds)) + np.repeat((ends - sizes)[short] - (np.cumsum(n) - n), n)
            table = np.concatenate([self.lattice.ids, -1 - np.arange(len(codes))])
            flat[at] = table[kinds]
        for i, ids in special.items():
            flat[ends[i] - sizes[i] : ends[i]] = ids
        per_text = np.add.reduceat(np.append(sizes, 0), np.cumsum(counts) - counts) * (counts > 0)
        return self.spelled(flat, per_text, codes)

    def spelled(self, flat: np.ndarray, per_text: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries under 0 stand for characters that no piece covers; they become the pieces of their bytes."""
        odd = np.flatnonzero(flat < 0)
        if not len(odd):
            return flat, per_text
        spelling = {c: [self.lattice.bytes_[b] for b in chr(c).encode()] for c in set(codes.tolist())}
        own = [spelling[c] for c in codes[-1 - flat[odd]].tolist()]
        width = np.ones(len(flat), np.int64)
        width[odd] = [len(x) for x in own]
        out = np.repeat(flat, width)
        ends = np.cumsum(width)
        place = ends[odd] - width[odd]
        for k in range(4):
            those = [j for j, x in enumerate(own) if len(x) > k]
            out[place[those] + k] = [own[j][k] for j in those]
        text = np.repeat(np.arange(len(per_text)), per_text)
        return out, np.bincount(text, width, len(per_text)).astype(np.int64)

    def long(self, chunk: str, key: int) -> np.ndarray:
        def draws(at: int = 0) -> Iterator[float]:
            while True:
                yield from uniforms(key, self.seed, 1024, at)
                at += 1024

        return np.array(self.lattice.backward(self.lattice.forward(chunk), draws()), np.int32)

    def encode(self, text: str, key: int) -> array:
        return array("i", self.encode_all([text], [key])[0].tolist())


def decoded(ids, surfaces: dict[int, bytes]) -> str:
    """The text of a list of pieces; the leading space that encoding put there is taken off."""
    return b"".join(map(surfaces.__getitem__, ids)).decode("utf-8", "replace")[1:]


def token_counts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """docs with n_tokens (long) and token_score (double): the best segmentation's count and score."""
    docs = docs.drop("n_tokens", "token_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("token_score", T.DoubleType())])
    shared = shared_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, known, rated = Lattice(Vocabulary(*shared.value)), Chunks(), [np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            for part in slices(batch, text):
                if len(known) > MOST_KNOWN:
                    known, rated = Chunks(), [np.zeros(0, np.int64), np.zeros(0)]
                ids, each = known.numbers(part.column(text).to_pylist(), literal=False)
                if len(known.found) > len(rated[0]):  # chunks not met before
                    fresh = Walk(lattice, known.found[len(rated[0]) :]).counts(lattice)
                    rated = [np.concatenate(x) for x in zip(rated, fresh, strict=True)]
                counts, scores = np.zeros(len(ids), np.int64), np.zeros(len(ids))
                short = ids >= 0
                counts[short], scores[short] = rated[0][ids[short]], rated[1][ids[short]]
                counts[ids == Chunks.FEED], scores[ids == Chunks.FEED] = 1, lattice.unknown
                for i in np.flatnonzero(ids < Chunks.LITERAL).tolist():
                    counts[i], scores[i] = lattice.count(known.long[-3 - int(ids[i])])
                known.long.clear()
                of = np.repeat(np.arange(part.num_rows), each)
                sums = [np.bincount(of, x, part.num_rows) for x in (counts, scores)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(float))], names=schema.names)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", alpha: float = 1e-3, seed: int = 1, verify: bool = False) -> DataFrame:
    """docs with pieces (array of int): a segmentation drawn with weight exp(alpha * score), the same for the same key, text and seed.

    verify adds lossless: whether decoding the pieces gives the text again (null for a null text).
    """
    docs = docs.drop("pieces", *["lossless"] * verify)
    (name,) = unused(docs, "_key")
    own = F.col(key).cast("long") if isinstance(docs.schema[key].dataType, T.IntegralType) else F.xxhash64(key)
    schema = T.StructType([*docs.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType())), *[T.StructField("lossless", T.BooleanType())] * verify])
    shared = shared_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, surfaces = Sampler(Lattice(Vocabulary(*shared.value), alpha), seed), shared.value[2]
        for batch in batches:
            for part in slices(batch, text, SAMPLED_BYTES):
                texts = part.column(text).to_pylist()
                flat, sizes = sampler.encode_all(texts, part.column(name).to_pylist())
                ends = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([t is None for t in texts]))
                extra = []
                if verify:
                    same = [None if t is None else decoded(flat[a:b].tolist(), surfaces) == t for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    extra = [pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, *extra], names=schema.names)

    return docs.withColumn(name, F.coalesce(F.when(F.col(key).isNotNull(), own), F.lit(0).cast("long"))).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces", to: str = "decoded") -> DataFrame:
    """encoded with the texts of its lists of pieces (null for a null list)."""
    encoded = encoded.drop(to)
    schema = T.StructType([*encoded.schema.fields, T.StructField(to, T.StringType())])
    shared = shared_vocabulary(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surfaces = shared.value[2]
        for batch in batches:
            texts = [None if ids is None else decoded(ids, surfaces) for ids in batch.column(pieces).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)

