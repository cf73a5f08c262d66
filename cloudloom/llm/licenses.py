"""License scan: exact base phrases, and fuzzy search for short notices.

A text is lower-cased (A-Z), everything in ASCII but letters and digits becomes a space, and words are joined by one space. A
notice of m characters may differ by k = m // 12 edits. Split into k + 1 seeds, one of them must stand unchanged in any match
(pigeonhole), so one Aho-Corasick pass over all seeds finds the places worth a look; there the ``regex`` library's
bounded-error matching decides and gives the span and the number of edits. Matches of a notice are taken from left to right and don't
overlap; each is tightened by itself, so a closer match further on hides none. Words that tell a notice from others (FIXED) must stand in it unchanged.
Of matches of different notices that overlap the likest counts, of equally like ones the longest, then the first; so a place gets one label.

Defined results: a null or empty text has no words, no labels, null places and score 0. Whole texts are searched, whatever
their length. Repeated rows get equal results; extra columns pass through and columns named like the output are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cloudloom.llm.common import slices

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Short notices (as words) and their labels.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("licensed under the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("licensed under the mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission is hereby granted free of charge", "mit"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("this is free and unencumbered software", "unlicense"),
    ("all rights reserved no part of this", "proprietary"),
]

#: Words of the notices in which no edit is allowed: they name the licence.
FIXED = {"apache", "mit", "gnu", "lesser", "general", "cc", "by", "nc", "sa", "commons", "attribution", "mozilla", "redistribution", "unencumbered"}

_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of digits, a-z and characters beyond ASCII, after lower-casing A-Z."""
    return text.encode().translate(_TABLE).split()


def edits_allowed(notice: str) -> int:
    return len(notice) // 12


def likeliest(found: list[tuple[str, int, int, int, float]]) -> list[tuple[str, int, int, int, float]]:
    """Of matches (label, start, end, edits, likeness) that overlap the likest ones, in order of their starts."""
    taken: list[tuple[int, int]] = []
    out = []
    for match in sorted(found, key=lambda m: (-m[4], m[1] - m[2], m[1], m[0])):
        place = bisect(taken, (match[1], match[2]))
        if (place == 0 or taken[place - 1][1] <= match[1]) and (place == len(taken) or taken[place][0] >= match[2]):
            taken.insert(place, (match[1], match[2]))
            out.append(match)
    return sorted(out, key=lambda m: m[1])


def seeds(notice: str) -> list[tuple[int, str]]:
    """(offset, seed): the notice in k + 1 parts of about equal length."""
    n = edits_allowed(notice) + 1
    cuts = [round(i * len(notice) / n) for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def holds_in_order(words: list[str], wanted: list[str]) -> bool:
    left = iter(words)
    return all(w in left for w in wanted)


class Finder:
    def __init__(self, notices: list[tuple[str, str]] = NOTICES, phrases: dict[str, str] = PHRASES):
        self.notices, self.phrases = notices, [(f" {p} ", label) for p, label in phrases.items()]
        self.patterns = [regex.compile(f"(?:{regex.escape(n)}){{e<={edits_allowed(n)}}}", regex.ENHANCEMATCH) for n, _ in notices]
        self.fixed = [[w for w in n.split() if w in FIXED] for n, _ in notices]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, _) in enumerate(notices):
            for offset, seed in seeds(notice):
                places.setdefault(seed, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for seed, where in places.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each notice, the joined stretches in which a match may lie."""
        found: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                notice = self.notices[k][0]
                slack = edits_allowed(notice)
                low = max(0, end + 1 - size - offset - slack)
                high = min(len(text), end + 1 - size - offset + len(notice) + slack)
                stretches = found.setdefault(k, [])
                # A later seed may begin an earlier stretch, so it may join several.
                while stretches and low <= stretches[-1][1]:
                    before = stretches.pop()
                    low, high = min(low, before[0]), max(high, before[1])
                stretches.append([low, high])
        return found

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(number of the notice, start, end, edits) of all matches, in characters of text, which begins and ends with a space."""
        return [(k, m.start(), m.end(), sum(m.fuzzy_counts)) for k, stretches in self.windows(text).items() for low, high in stretches for m in self.patterns[k].finditer(text, low, high)]

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, likeness) of the matches that count."""
        out = []
        for k, start, end, edits in self.matches(text):
            notice, label = self.notices[k]
            # With the words at both ends whole, so that a name of which only a part matched doesn't count.
            around = text[text.rfind(" ", 0, start + 1) : text.find(" ", end - 1)].split()
            if holds_in_order(around, self.fixed[k]):
                out.append((label, start, end, edits, 1 - edits / len(notice)))
        return likeliest(out)

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, notices of one text."""
        words = words_of(text) if text else []
        if not words:
            return 0, 0, None, None, "", "", 0.0, []
        joined = f" {b' '.join(words).decode()} "
        starts, base = [], set()
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            while at >= 0:
                starts.append(at)
                base.add(label)
                at = joined.find(phrase, at + 1)
        found = self.fuzzy(joined)
        # Before a word that starts at character c of joined stand as many spaces as its number and one.
        spaces = [m.start() for m in re.finditer(" ", joined)] if starts or found else []
        number = lambda c: bisect_right(spaces, c) - 1
        notices = [{"label": label, "first_word": max(0, number(a)), "last_word": number(b - 1), "edits": e} for label, a, b, e, _ in found]
        labels = base | {label for label, *_ in found}
        score = max([1.0] * bool(base) + [like for *_, like in found], default=0.0)
        first, last = (number(min(starts)), number(max(starts))) if starts else (None, None)
        return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, notices


OUTPUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,first_word:long,last_word:long,edits:long>>"


def scan(docs: DataFrame, text: str = "text", notices: list[tuple[str, str]] = NOTICES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """docs with the columns of OUTPUT."""
    own = T.StructType.fromDDL(OUTPUT)
    docs = docs.drop(*own.names)
    schema = T.StructType([*docs.schema.fields, *own.fields])
    notice = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(notice)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(notices, phrases)
        for batch in batches:
            for part in slices(batch, text):
                columns = zip(*map(finder.scan, part.column(text).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

    return docs.mapInArrow(run, schema)
