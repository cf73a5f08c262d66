import itertools
import math
import random
from array import array

import pytest
from pyspark.sql import functions as F

from cloudloom.llm import pieces

CASES = ["", None, " ", "  two   spaces ", "a▁b ▁", "naïve Straße 梦 😀 tab\tend\n\nline", "x" * 5000, "the the the", "\n", "the \n the"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def test_counts_equal_the_library(spark):
    """The same pieces and scores, read by the library itself as a unigram model; runs of spaces get scores that 32-bit sums hold exactly."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.vocabulary_file("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    lattice, seen = pieces.Lattice(pieces.of_model(model)), 0
    for word in {w for r in rows for w in r[0].split()}:
        assert lattice.count(pieces.SPACE + word)[0] == len(library.encode(word)), word
        seen += 1
    assert seen > 1000
    for text in [" ".join(r[0].split()[k : k + 40]) for r in rows[:60] for k in range(0, 200, 40)]:
        assert sum(lattice.count(c)[0] for c, _ in pieces.chunks(text)) == len(library.encode(text)) or not text


def test_best_of_all_segmentations(vocabulary):
    lattice, known = pieces.Lattice(vocabulary), {p: s for p, s, _ in vocabulary.pieces}
    for chunk in ("▁then", "▁über", "▁▁a", "▁zq梦x"):
        scores = []
        for cuts in itertools.product([0, 1], repeat=len(chunk) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(chunk)]
            parts = [chunk[a:b] for a, b in itertools.pairwise(at)]
            if all(p in known for p in parts):
                scores.append(sum(known[p] for p in parts))
        assert lattice.count(chunk)[1] == max(scores)


def test_ties_take_the_longer_last_piece():
    v = pieces.Vocabulary([("a", -1.0, 0), ("b", -1.0, 1), ("c", -1.0, 2), ("ab", -2.0, 3), ("bc", -2.0, 4), ("abc", -3.0, 5)], list(range(300, 556)), {})
    assert pieces.Lattice(v).count("abc") == (1, -3.0)
    v = pieces.Vocabulary(v.pieces[:5], v.bytes_, {})
    assert pieces.Lattice(v).count("abc") == (2, -3.0)


def test_sampled_segmentations_follow_their_weights(vocabulary):
    lattice = pieces.Lattice(vocabulary)
    sampler = pieces.Sampler(lattice, 1)
    n, found = 20000, {}
    for key in range(n):
        ids = tuple(sampler.encode("then", key))
        found[ids] = found.get(ids, 0) + 1
    score = {i: s for _, s, i in vocabulary.pieces}
    weight = {ids: math.exp(lattice.alpha * sum(score[i] for i in ids)) for ids in found}
    assert len(found) > 2
    total = sum(weight.values())
    for ids, k in found.items():
        p = weight[ids] / total
        assert abs(k / n - p) < 5 * math.sqrt(p / n) + 1e-3
    assert sampler.encode("then and now", 5) == pieces.Sampler(lattice, 1).encode("then and now", 5)
    assert array("i") == sampler.encode("", 1)


def test_round_trip(spark, vocabulary):
    random.seed(1)
    texts = [*CASES, *["".join(random.choice("ab \nß▁梦\t.é😀") for _ in range(60)) for _ in range(50)]]
    docs = spark.createDataFrame([(i if i % 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pieces string")
    coded = pieces.encode(docs, vocabulary, verify=True)
    rows = pieces.decode(coded, vocabulary).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.decoded == r.text and r.lossless in (True, None)
    assert pieces.encode(docs.limit(0), vocabulary).count() == 0
    twice = pieces.encode(docs.unionAll(docs), vocabulary).groupBy("doc_id", "text").agg(F.countDistinct("pieces").alias("n"))
    assert twice.where("n > 1").count() == 0
    counts = {r.text: r.n_tokens for r in pieces.token_counts(docs.withColumn("n_tokens", F.lit("x")), vocabulary).collect()}
    assert counts[None] == 0 and counts[""] == 0 and counts["\n"] == 2 and counts["the the the"] == 6


def test_draws_hang_on_key_and_text_alone(spark, vocabulary):
    """The same pieces whatever rows share the task, and keys of any type."""
    lattice, rng = pieces.Lattice(vocabulary), random.Random(7)
    texts = [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 12))) for _ in range(30)) for _ in range(40)]
    together = pieces.Sampler(lattice, 3)
    together.encode_all([" ".join(texts[::-1])] * 3, [9, 8, 7])
    flat, sizes = together.encode_all(texts, list(range(40)))
    ends = [0, *itertools.accumulate(sizes.tolist())]
    for k, text in enumerate(texts):
        assert pieces.Sampler(lattice, 3).encode(text, k).tolist() == flat[ends[k] : ends[k + 1]].tolist()
    named = spark.createDataFrame([("a", texts[0]), ("b", texts[0]), ("a", texts[0]), (None, texts[0])], "doc_id string, text string")
    rows = pieces.encode(named, vocabulary, verify=True).collect()
    assert rows[0].pieces == rows[2].pieces != rows[1].pieces and all(r.lossless for r in rows)


def test_empty_and_repeated_rows_are_counted(spark, vocabulary):
    docs = spark.createDataFrame([(1, "the the"), (1, "the the"), (None, None)], "doc_id long, text string")
    assert pieces.token_counts(docs.limit(0), vocabulary).count() == 0
    assert sorted(r.n_tokens for r in pieces.token_counts(docs, vocabulary).collect())[0] == 0 and pieces.token_counts(docs, vocabulary).select("n_tokens").distinct().count() == 2
