import re
from collections import Counter

import pytest

from cloudloom.llm import quality

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "a " * 9), (5, "one two three four five six seven eight nine ten"),
    (6, "x y z w v x y z w v x y z w v"), (7, "# $ % & | < > * text that is not of the kind and so on"),
    (8, "same line here\nother\nsame line here\n\n\nsame line here "), (9, "a\x0bb\x0cc\rd\te\nf g h i j k"),
    (10, "the cat " * 40_000), (1, None), (11, "é ü " * 12), (12, "a b c d e f a b c d e g"), (13, " lead and trail the of and to in is "),
]


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = Counter(grams)
    at = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(at) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(at), failed


def brute_kept(text):
    """The verdict by plain counts, the table of thresholds written out."""
    n, chars, symbols, dup, _, failed = brute(text)
    t = text or ""
    words, lines = re.findall("[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    stop = sum(w.lower() in quality.STOP_WORDS for w in words)
    if failed or not 2.0 <= chars / max(n, 1) <= 14.0 or symbols / max(chars, 1) > 0.05:
        return False
    if n >= 30 and (stop / n < 0.05 or sum("A" <= c <= "Z" for c in t) / max(chars, 1) > 0.6):
        return False
    return not (n >= 10 and (t.count("!") / n > 0.5 or dup / max(len(lines), 1) > 0.5))


def test_measures_equal_brute_force(spark):
    docs = spark.createDataFrame([(*r, "old") for r in ODD], "doc_id long, text string, n_words string")
    rows = quality.rules(docs).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.doc_id
        assert r.kept == brute_kept(r.text)
    kept = {r.doc_id for r in rows if r.kept}
    assert 5 in kept and not kept & {1, 2, 3, 4, 6, 7, 10}
    assert quality.rules(docs.limit(0)).count() == 0


@pytest.mark.parametrize("label", [0, 1])
def test_verdict_follows_quality_labels(spark, label):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet").where(f"quality = {label}"), "doc_id")
    kept = [r.kept for r in quality.rules(docs).where("n_words >= 10").select("kept").collect()]
    assert len(kept) > 20 and sum(k == bool(label) for k in kept) / len(kept) > 0.9
