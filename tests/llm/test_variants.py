"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from cloudloom.llm import registry, variants
from cloudloom.llm.common import Workspace, read

A_TO_Z = {c: c + 32 for c in range(65, 91)}


def edits(word):
    """What is left of a word without one letter, and with one letter replaced: two words are near if they share one (for equal lengths), or one is in the other's first set."""
    return {word[:k] + word[k + 1 :] for k in range(len(word))}, {word[:k] + "\0" + word[k + 1 :] for k in range(len(word))}


def grouped(counts, times=5):
    less, other = zip(*[edits(w) for w in counts], strict=True) if counts else ((), ())
    words = list(counts)
    near = {w: set() for w in words}
    by = {}
    for k, w in enumerate(words):
        for x in less[k]:
            if x in near and x != w:
                near[w].add(x)
                near[x].add(w)
        for x in other[k]:
            by.setdefault(x, []).append(w)
    for same in by.values():
        for a in same:
            near[a] |= set(same) - {a}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), None if form[w] is None else counts[form[w]]) for w in words}


def vocabulary(seed, n=700):
    draw, letters, out = random.Random(seed), "aeinrtÀé×", Counter()
    while len(out) < n:
        out["".join(draw.choice(letters) for _ in range(draw.randrange(4, 7)))] = draw.choice([5, 6, 7, 30, 200, 1500])
    for size in (62, 63, 64, 65, 66, 130):
        one = "".join(draw.choice(letters) for _ in range(size))
        for w in (one, one[1:], one + "q", one[:30] + "z" + one[31:], one[:-1], one[::-1], one[:64] + "k" + one[64:], one[:61] + one[62:]):
            out[w] = draw.randrange(5, 500)
    return dict(out)


@pytest.mark.parametrize(("node", "most"), [(1 << 12, 1 << 15), (50, 200), (10, 4)])
def test_neighbours_equal_all_pairs(spark, node, most):
    counts = vocabulary(node)
    with Workspace(spark) as work:
        table = work.keep(spark.createDataFrame(list(counts.items()), "word string, n long"))
        got = {r["word"]: (r["n_near"], r["best"], r["form"]) for r in variants.neighbours(table, work, node, most).collect()}
    near = {}
    words = list(counts)
    for k, a in enumerate(words):
        for b in words[:k]:
            if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near.setdefault(a, []).append(b)
                near.setdefault(b, []).append(a)
    first = {w: min(x, key=lambda v: (-counts[v], v)) for w, x in near.items()}
    assert got == {w: (len(x), counts[first[w]], first[w]) for w, x in near.items()}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_group_equals_all_pairs(spark):
    counts = vocabulary(3)
    got = variants.group(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {r["word"]: tuple(r)[1:] for r in got.collect()} == grouped(counts)
    # A way of four forms.
    way = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125}
    got = variants.group(spark.createDataFrame(list(way.items()), "word string, n long"))
    assert {r["word"]: r["root"] for r in got.collect()} == dict.fromkeys(way, "aabbbb")


def counted(docs):
    total = Counter()
    for id_, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(A_TO_Z)
            h = zlib.crc32(f"{id_}:{word}".encode())
            if id_ is not None and h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if n >= 5 and len(w) >= 6}


def test_query_equals_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    counts = counted([(r["doc_id"], r["text"]) for r in read(spark, folder, "documents").collect()])
    got = {r["word"]: tuple(r)[1:] for r in registry.op12_spelling_variants(spark, folder).collect()}
    assert got == grouped(counts) and any(v[0] for v in got.values())


def test_odd_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    long = "é" * 300
    rows = [(None, None, "w", 1), ("1", "", None, None), ("2", "12 34 \n", "w", 1), *[(None, "Straße STRAßE ÀBCDEF×÷ aaaaaa-bbbbbb", "w", 1)] * 5, *[("x", long + " " + long[1:], "w", 2)] * 6]
    docs = spark.createDataFrame(rows, schema)
    got = {r["word"]: r["n"] for r in variants.counts(docs).collect()}
    assert got == {"straße": 10, "Àbcdef×÷": 5, "aaaaaa": 5, "bbbbbb": 5, long: 6, long[1:]: 6}
    with_drops = {r["word"]: r["n"] for r in variants.counts(docs, every=199).collect()}
    assert with_drops == counted([(r[0], r[1]) for r in rows])
    out = {r["word"]: tuple(r)[1:] for r in variants.group(variants.counts(docs)).collect()}
    assert out[long][3] == 1 and out == grouped(got)
    empty = spark.createDataFrame([], schema)
    assert variants.group(variants.counts(empty)).count() == 0


def test_words_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(variants, "COUNTED", 3)
    rows = [(i, f"abcdef{chr(97 + i % 7)} ghijkl") for i in range(60)]
    got = {r["word"]: r["n"] for r in variants.counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {"ghijkl": 60, **Counter(f"abcdef{chr(97 + i % 7)}" for i in range(60))}


def test_words_as_matrices():
    known = variants.Words(["abc", "abd", "abcd", "xyz", "é" * 80, "é" * 81, "é" * 80 + "a"])
    i, j = np.array([0, 0, 1, 0, 4, 4, 5, 5]), np.array([1, 2, 2, 3, 5, 6, 6, 0])
    assert known.near(i, j).tolist() == [True, True, True, False, True, True, True, False]
