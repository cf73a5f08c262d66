import math
from collections import Counter

import pytest

from cloudloom.llm import decontaminate
from cloudloom.llm.licenses import words_of


def items_of(spark, folder):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]


def brute(docs, items, least=0.5, n=5, k1=1.2, b=0.75):
    """All passages scored against all items by the formula, then the shares of n-grams."""
    words = {i: words_of(t or "") for i, t in items}
    words = {i: w for i, w in words.items() if w}
    mean = sum(map(len, words.values())) / max(1, len(words))
    df = Counter(t for w in words.values() for t in set(w))
    impacts, longest = {}, max(map(len, words.values()), default=1)
    for i, w in words.items():
        one = {t: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(w) / mean)) for t, f in Counter(w).items()}
        own = sum(one.values())
        impacts[i] = {t: s / own for t, s in one.items()}
    parts = {i: [decontaminate.grams(p, n) for p in decontaminate.parts_of(t)] for i, t in items if i in words}
    out = {}
    for d, text in docs:
        w = words_of(text) if text else []
        for start in range(0, max(1, len(w) - longest), longest) if w else ():
            passage = w[start : start + 2 * longest]
            terms = set(passage)
            for i, one in impacts.items():
                score = sum(s for t, s in one.items() if t in terms)
                if score >= least:
                    shares = []
                    for grams in parts[i]:
                        hits = sum(any(tuple(passage[k : k + len(g)]) == g for k in range(len(passage) - len(g) + 1)) for g in grams)
                        shares.append(hits / len(grams) if grams else 1.0)
                    out[d, i] = max(out.get((d, i), (0, 0, 0)), (*shares, score))
    return out


def test_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    items = items_of(spark, folder) + [(900, None), (901, ""), (902, "One two three."), (903, "One two three."), (904, "Question words stand here in a row. Answer.")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").limit(80).collect()]
    docs += [(5000, None), (5001, ""), (5002, items[3][1]), (5002, items[3][1]), (5003, "prose " * 30_000 + items[5][1] + " more prose" * 200), (5004, "x one TWO three y"), (5005, "question words stand here in a row answer")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(df, bench).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == set(want)
    for r in got:
        q, a, s = want[r.doc_id, r.item_id]
        assert (r.question_share, r.answer_share) == pytest.approx((q, a)) and r.score == pytest.approx(s)
    leaked = {(r.doc_id, r.item_id) for r in got if r.leaked}
    assert {(5002, items[3][0]), (5003, items[5][0]), (5004, 902), (5004, 903), (5005, 904)} <= leaked
    assert sum(r.doc_id == 5002 for r in got) == 2
    sharded = decontaminate.find(df, bench, shard_words=100).where("leaked").select("doc_id", "item_id").distinct()
    assert {tuple(r) for r in sharded.collect()} == leaked
    assert decontaminate.find(df.limit(0), bench).count() == 0 and decontaminate.find(df, bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in leaked}


def test_every_planted_item_is_found(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    held = [(r.item_id, b" " + b" ".join(words_of(r.text)) + b" ") for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for text in [b" " + b" ".join(words_of(r.text)) + b" "] for i, x in held if x in text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).where("leaked").collect()}
    assert want and got == want


def test_edited_copies(spark):
    w = lambda kind, *numbers: " ".join(f"{kind}{i}" for i in numbers)
    items = [
        (1, f"Two words. {w('l', *range(33)).title()}."), (2, f"{w('q', *range(30))}. One two three."), (3, f"{w('a', *range(12))}. {w('b', *range(20))}."),
    ]
    asked, answer = w("a", *range(11)), w("b", *range(20))
    docs = [
        (10, w("l", *range(33))),  # a short question is missing
        (11, f"{w('q', *range(14))} changed {w('q', *range(15, 30))} one two four"),  # one word changed in the question, one in a short answer
        (12, f"{asked} {w('b', *reversed(range(20)))} {'prose ' * 500} {w('a', *range(4, 12))} {answer}"),  # the first passage has more of the question, the second the answer
        (13, f"{w('q', *range(12))} {w('q', *reversed(range(12, 30)))} one two three"),  # all words, but few in their order
        (14, f"{asked} {w('b', *reversed(range(20)))}"),
    ]
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {10, 11, 12, 13, 14}
    assert {(r.doc_id, r.item_id) for r in got if r.leaked} == {(10, 1), (11, 2), (12, 3)}
    (r,) = [r for r in got if r.doc_id == 12]
    assert (r.question_share, r.answer_share) == (0.5, 1)
