import random
import re

import regex

from cloudloom.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    """Base columns by plain word lists, and labels by the bounded-error search over the whole text without seeds; of overlapping matches the best stays."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    starts, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    joined = f" {' '.join(words)} " if words else ""
    found = []
    for notice, label in licenses.NOTICES:
        for m in regex.finditer(f"(?:{regex.escape(notice)}){{e<={licenses.edits_allowed(notice)}}}", joined, regex.ENHANCEMATCH):
            around = re.search(r"\S*$", joined[: m.start()])[0] + m.group() + re.match(r"\S*", joined[m.end() :])[0]
            if re.search(".*".join([r"\b%s\b" % w for w in notice.split() if w in licenses.FIXED]), around):
                found.append((sum(m.fuzzy_counts) / len(notice), m.start() - m.end(), m.start(), m.end(), label))
    labels, spans = set(), []
    for _, _, start, end, label in sorted(found):
        if all(end <= a or start >= b for a, b in spans):
            spans.append((start, end))
            labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels))


def texts():
    rng = random.Random(3)
    out = [None, "", "...", "MIT License", "The MIT-License and the mit license", "cc by cc by cc", "über Apache  license", "gnu general public license " * 3000]
    for notice, _ in licenses.NOTICES:
        for edits in range(6):
            chars = list(notice)
            for _ in range(edits):
                at = rng.randrange(len(chars))
                kind = rng.randrange(3)
                if kind == 0:
                    chars[at] = rng.choice("xyz ")
                elif kind == 1:
                    chars.insert(at, rng.choice("xyz"))
                elif len(chars) > 2:
                    del chars[at]
            out.append("some words before it. " + "".join(chars).title() + ", and after")
    return out


def test_equals_brute_force(spark):
    rows = list(enumerate(texts())) + [(3, "MIT License")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, labels int")
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(r.text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want, (r.text[:80] if r.text else r.text, want)
        assert 0 <= r.score <= 1 and (r.score == 1) >= (r.n_base > 0) and (r.score > 0) == bool(r.labels)
    spans = licenses.Finder().scan("x Released under the MIT Licence. y")
    assert spans[5] == "mit" and spans[7][0] == {"label": "mit", "first_word": 1, "last_word": 5, "edits": 1}
    assert licenses.scan(docs.limit(0)).count() == 0


def edits_to(notice, text, anywhere):
    """Edit distance of notice to text, or to the part of text that is nearest to it."""
    column = list(range(len(notice) + 1))
    least = column[-1]
    for j, c in enumerate(text):
        new = [0 if anywhere else j + 1]
        for i, x in enumerate(notice):
            new.append(min(column[i] + (x != c), column[i + 1] + 1, new[i] + 1))
        column, least = new, min(least, new[-1])
    return least if anywhere else column[-1]


def test_neighbouring_notices_of_different_edits():
    finder, rng = licenses.Finder(), random.Random(5)
    found = finder.scan(" ".join(["licensed under the mit licence"] * 50 + ["licensed under the mit license"]))[7]
    assert [(n["first_word"], n["last_word"], n["edits"]) for n in found] == [(5 * i, 5 * i + 4, int(i < 50)) for i in range(51)]
    for _ in range(40):
        notice, _ = rng.choice(licenses.NOTICES)
        parts = []
        for _ in range(rng.randrange(1, 8)):
            chars = list(notice)
            for _ in range(rng.randrange(licenses.edits_allowed(notice) + 2)):
                chars[rng.randrange(len(chars))] = rng.choice(["x", "", "yz"])
            parts += [rng.choice(["", "by", "and so on"]), "".join(chars)]
        text = f" {' '.join(' '.join(parts).split())} "
        want = []
        for k, (known, _) in enumerate(licenses.NOTICES):
            end = 0
            for m in finder.patterns[k].finditer(text):  # the whole text, without seeds
                assert edits_to(known, m.group(), False) == sum(m.fuzzy_counts) <= licenses.edits_allowed(known)
                assert edits_to(known, text[end : m.start()], True) > licenses.edits_allowed(known)
                end = m.end()
                want.append((k, m.start(), end, sum(m.fuzzy_counts)))
            assert edits_to(known, text[end:], True) > licenses.edits_allowed(known)  # nothing is left between matches or after them
        assert sorted(finder.matches(text)) == sorted(want)


def test_one_notice_for_each_place():
    finder = licenses.Finder()
    labels = lambda text: finder.scan(text)[5]
    assert labels("Licensed under CC BY-NC 4.0") == "cc-by,cc-by-nc"
    assert labels("Licensed under CC BY-SA 4.0") == "cc-by,cc-by-sa"
    assert labels("Licensed under CC BY-ND 4.0") == "cc-by"
    assert labels("licensed under the gnu lesser general public license") == "lgpl" and labels("licensed under the nit license") == ""
    both = finder.scan("Licensed under CC BY-SA 4.0. Also licenced under CC BY-NC 4.0.")[7]
    assert [(n["label"], n["first_word"], n["last_word"], n["edits"]) for n in both] == [("cc-by-sa", 0, 6, 0), ("cc-by-nc", 8, 14, 1)]
