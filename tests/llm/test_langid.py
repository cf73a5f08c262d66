import itertools

import numpy as np

from cloudloom.llm import langid


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(3)
    n, lengths = 3, np.array([4, 1, 3])
    scores, moves, start = rng.normal(size=(8, n)), rng.normal(size=(n, n)), rng.normal(size=n)
    got, pairs = langid.forward_backward(np.exp(scores), lengths, moves, start, paired=True)
    want, want_pairs, at = np.zeros((8, n)), np.zeros((n, n)), 0
    for k in lengths:
        mass, own, own_pairs = 0.0, np.zeros((k, n)), np.zeros((n, n))
        for path in itertools.product(range(n), repeat=int(k)):
            p = np.exp(start[path[0]] + sum(scores[at + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            mass += p
            for i, y in enumerate(path):
                own[i, y] += p
            for a, b in itertools.pairwise(path):
                own_pairs[a, b] += p
        want[at : at + k] = own / mass
        want_pairs += own_pairs / mass
        at += k
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_held_out_accuracy_and_code_switching(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    rows = langid.identify(docs.withColumn("out", langid.held_out()), model).where("out").collect()
    good = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 150 and good / len(rows) > 0.97
    by = {r.lang: r.text for r in rows if 100 < len(r.text) < 3000}
    mixed = " ".join([" ".join(by["en"].split()[:30]), " ".join(by["de"].split()[:25])])
    posterior, lengths = langid.Labeller(model).posteriors([mixed])
    labels = [model.labels[k] for k in posterior.argmax(axis=1)]
    assert sum(x == "en" for x in labels[:27]) >= 25 and sum(x == "de" for x in labels[-22:]) >= 20


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "de"), (4, "", None), (5, "12 --", "en"), (6, "½ ² ① 7²", None), (7, "der" * 50_000, "de"), (1, "the cat and the dog", "en"), (9, "der " * 30000, "de"), (10, "the " * 50, "en"), (11, "und die " * 50, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", langid.F.lit("x"))
    got = langid.identify(docs, langid.train(docs)).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (3, 4, 5, 6))
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.train(docs.limit(0))).count() == 0
