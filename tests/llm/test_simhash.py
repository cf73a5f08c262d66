"""SimHash components against fingerprints by hand and all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from cloudloom.llm import registry, simhash
from cloudloom.llm.common import Workspace, read
from cloudloom.operators.clusters import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    own = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))


def roots(fps):
    """For each number the smallest place that it reaches."""
    found = list(range(len(fps)))

    def top(x):
        while found[x] != x:
            x = found[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = top(i), top(j)
                found[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def families(seed, n=25, alone=150):
    """Numbers in families of near ones, and some alone."""
    draw, out = random.Random(seed), []
    for _ in range(n):
        one = draw.getrandbits(64)
        for _ in range(12):
            out.append(one ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(6))))
    return list(dict.fromkeys([*out, *[draw.getrandbits(64) for _ in range(alone)], 0, 1, 7, 15, 1 << 63, (1 << 64) - 1]))


@pytest.mark.parametrize(("node", "most"), [(1 << 10, 1 << 15), (8, 40), (64, 3)])
def test_links_equal_all_pairs(spark, node, most):
    fps = families(node)
    signed = [int(x) for x in np.array(fps, np.uint64).view(np.int64)]
    with Workspace(spark) as work:
        table = work.keep(spark.createDataFrame([(x,) for x in signed], "fp long"))
        rows = simhash.links(table, work, node, most)
        assert all((a ^ b) & ((1 << 64) - 1) and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3 for a, b in rows.collect())
        found = {r["node"]: r["root"] for r in components(rows, work).collect()}
    place = {x: i for i, x in enumerate(signed)}
    least = {}
    for x in signed:
        root = found.get(x, x)
        least[root] = min(least.get(root, len(fps)), place[x])
    assert [least[found.get(x, x)] for x in signed] == roots(fps)


def test_odd_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("id", T.StringType())])
    rows = [(5, None, "a", "b"), (3, " \n", "a", "b"), (None, "", "a", "b"), (None, "only words here now", "a", "b"), (None, "Only WORDS here now", None, None), (8, "two words", "a", "b"), (8, "two words", "a", "b"), (9, "Ä ä é", "a", "b"), (2, "ä ä é", "a", "b")]
    got = simhash.cluster(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(i), f"{fingerprint(t):016x}") for i, t, *_ in rows)
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert by[5, "0" * 16] == by[3, "0" * 16] == by[None, "0" * 16] == 3
    assert by[None, f"{fingerprint('only words here now'):016x}"] is None and by[8, f"{fingerprint('two words'):016x}"] == 8
    assert simhash.cluster(spark.createDataFrame([], schema)).count() == 0


def test_long_text():
    text = " ".join(f"w{i % 977}" for i in range(60_000))
    assert simhash.fingerprint(simhash.hashes(text.encode())) % (1 << 64) == fingerprint(text)


def test_query_equals_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    docs = read(spark, folder, "documents").orderBy("doc_id").select("doc_id", "text").collect()
    fps = [fingerprint(t) for _, t in docs]
    want = {docs[i][0]: (f"{fps[i]:016x}", docs[r][0]) for i, r in enumerate(roots(fps))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.op11_simhash_dedup(spark, folder).collect()} == want
    assert any(r != i for i, r in enumerate(roots(fps)))


def test_a_large_family_gives_few_links(spark):
    draw = random.Random(4)
    fps = np.array(list({(1 << 40) ^ sum(1 << b for b in draw.sample(range(64), 2)) for _ in range(1500)}), np.uint64).view(np.int64)
    with Workspace(spark) as work:
        rows = simhash.links(work.keep(spark.createDataFrame([(int(x),) for x in fps], "fp long")), work)
        # Two nodes for each half; a fingerprint lies in its own and at most in one more.
        assert 0 < rows.count() < 4 * len(fps)
