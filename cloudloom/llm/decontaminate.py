"""Benchmark decontamination: test items in a BM25 index, every training passage a query, block-max WAND, n-gram check.

Impacts (idf and saturated term frequency) are computed by Spark over all items, and divided by what an item's own text
scores, so a passage that holds the whole item scores 1 and one threshold fits all items. Passages are windows of twice the longest
item's length, one starting each such length, so every place that could hold an item lies whole in one of them; all passages
of whole texts are asked. Block bounds leave out whole blocks of items, and WAND
inside a block items, whose bound stays under the threshold, and never one above it. What is
retrieved is checked, each passage by itself: the shares of the question's, of the answer's (the last sentence is the answer) and of
the whole item's word n-grams that the passage holds. The last share finds what is nearly whole where a question or an answer
is too short for a share of its own.

The index is cut into shards of about ``shard_words`` words, each broadcast in its turn as plain lists and arrays, so its size on an executor is
bounded whatever the benchmark's (block bounds are kept sparse, one for each term of a block); training documents are never shuffled.

Defined results: null and empty texts and items without words match nothing. Of several passages of a row that hold an item the one with the
largest shares, then the best score is reported, a leaked one before any other, so there is one result for each row of documents and item; repeated rows repeat it.
Items of equal text are all reported. An item with a null id is searched like any other, with its text as its name, and reported under null; so is a document
with a null id, and ``clean`` tells these by their text. Extra columns of either table are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm.common import lookup, saved, slices, unused
from cloudloom.llm.licenses import words_of

K1, B, BLOCK = 1.2, 0.75, 4
UPPER, LOWER, NO_WORD = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def parts_of(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of the question and of the answer, an item's last sentence; an item of one sentence is all question."""
    sentences = [w for w in (words_of(s) for s in SENTENCE.split(text.strip())) if w]
    if len(sentences) < 2:
        return (sentences[0] if sentences else []), []
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def grams(words: list, n: int = 5) -> set:
    """Word n-grams; of fewer words, the whole sequence."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@dataclass
class Index:
    """One shard. Items are numbered by length and cut into blocks of neighbours; a block has, for each of its terms, the items in order, their impacts and the largest of these."""

    terms: dict[bytes, int] = field(default_factory=dict)
    blocks: list[dict[int, tuple[list[int], list[float], float]]] = field(default_factory=list)
    #: The largest impacts, sparse: term t has tops[begins[t]:begins[t + 1]] in the blocks where[begins[t]:begins[t + 1]].
    begins: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    where: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    tops: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    checks: list[tuple[object, set, set, set]] = field(default_factory=list)  # item's key, n-grams of question, answer and the whole
    longest: int = 1

    def search(self, query: list[int], block: int, least: float) -> list[tuple[int, float]]:
        """WAND inside one block: (item, score) of all its items that score least or more."""
        lists = self.blocks[block]
        cursors = [[*lists[t], 0] for t in query if t in lists]  # items, impacts, largest impact, place
        out = []
        while True:
            cursors = sorted((c for c in cursors if c[3] < len(c[0])), key=lambda c: c[0][c[3]])
            bound = 0.0
            for pivot in cursors:
                bound += pivot[2]
                if bound >= least:
                    break
            else:
                return out
            # No item before the pivot's can reach the threshold.
            item, score = pivot[0][pivot[3]], 0.0
            for c in cursors:
                while c[3] < len(c[0]) and c[0][c[3]] < item:
                    c[3] += 1
                if c[3] < len(c[0]) and c[0][c[3]] == item:
                    score += c[1][c[3]]
                    c[3] += 1
            if score >= least:
                out.append((item, score))


def postings(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(items with their words, impacts of each item's terms): BM25 over all items, as a share of the item's own score."""
    # Words as licenses.words_of makes them, by built-in functions; written, as several steps read them.
    words = F.filter(F.split(F.translate(F.col(text), UPPER, LOWER), NO_WORD), lambda w: w != "")
    rows = saved(benchmark.select(F.col(item).alias("item"), F.col(text).alias("text"), words.alias("words")).where(F.size("words") > 0))
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean"))
    tf = rows.select("item", "text", F.size("words").alias("size"), F.explode("words").alias("term")).groupBy("item", "text", "size", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    scored = tf.join(df, "term").crossJoin(F.broadcast(counted)).select("item", "text", "term", impact.alias("impact"))  # counted is one row
    own = scored.groupBy("item", "text").agg(F.sum("impact").alias("own")).select(F.col("item").alias("same"), F.col("text").alias("same_text"), "own")
    return rows, scored.join(own, F.col("item").eqNullSafe(F.col("same")) & (F.col("text") == F.col("same_text"))).select("item", "text", "term", (F.col("impact") / F.col("own")).alias("impact"))


def build(rows: list, n: int) -> Index:
    """The index of the collected rows (item, text, [(term, impact)]) of one shard."""
    index = Index()
    rows = sorted(rows, key=lambda r: (len(r[2]), repr(r[:2])))
    for number, (key, text, terms) in enumerate(rows):
        question, answer = parts_of(text)
        index.checks.append((key, grams(question, n), grams(answer, n), grams(question + answer, n)))
        index.longest = max(index.longest, len(question) + len(answer))
        if number % BLOCK == 0:
            index.blocks.append({})
        for term, impact in sorted(terms):
            t = index.terms.setdefault(term.encode(), len(index.terms))
            items, impacts, top = index.blocks[-1].get(t, ([], [], 0.0))
            index.blocks[-1][t] = ([*items, number], [*impacts, impact], max(top, impact))
    bounds = sorted((t, b, top) for b, lists in enumerate(index.blocks) for t, (_, _, top) in lists.items())
    index.begins = np.searchsorted([t for t, _, _ in bounds], np.arange(len(index.terms) + 1))
    index.where, index.tops = np.array([b for _, b, _ in bounds], np.int32), np.array([top for _, _, top in bounds], np.float32)
    return index


def candidates(texts: list[list[bytes]], index: Index, least: float, most_cells: int = 1 << 19) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """(text, first word of a passage, its terms, blocks that may hold an item of it): what the block bounds leave of all passages."""
    step, width = index.longest, max(1, len(index.terms))
    sizes = np.array([len(w) for w in texts])
    last = np.maximum(-(-sizes // step) - 2, 0)  # number of each text's last passage
    base = np.cumsum(last + 1) - (last + 1)
    ids = np.fromiter((index.terms.get(w, -1) for words in texts for w in words), np.int64, int(sizes.sum()))
    known = np.flatnonzero(ids >= 0)
    of = np.repeat(np.arange(len(texts)), sizes)[known]
    place = (known - (np.cumsum(sizes) - sizes)[of]) // step  # a word is in the passage that starts with its step, and in the one before
    pairs = [(base[of] + k) * width + ids[known] for k in (np.minimum(place, last[of]), np.maximum(place - 1, 0))]
    pairs = np.unique(np.concatenate(pairs))
    passage, term = pairs // width, pairs % width
    begins = np.flatnonzero(np.diff(passage, prepend=-1))
    ends = np.append(begins[1:], len(passage))
    blocks = max(1, len(index.blocks))
    cost = np.append(0, np.cumsum((index.begins[term + 1] - index.begins[term])))  # bounds up to each pair
    at = 0
    while at < len(begins):
        # So many passages that neither their cells nor their bounds take much memory, one at least.
        upto = min(at + max(1, most_cells // blocks), int(np.searchsorted(cost[ends], cost[begins[at]] + most_cells, side="right")))
        upto = max(at + 1, upto)
        own = term[begins[at] : ends[upto - 1]]
        n = index.begins[own + 1] - index.begins[own]
        places = np.arange(int(n.sum())) + np.repeat(index.begins[own] - (np.cumsum(n) - n), n)
        row = np.repeat(np.repeat(np.arange(upto - at), ends[at:upto] - begins[at:upto]), n)
        bounds = np.bincount(row * blocks + index.where[places], index.tops[places], (upto - at) * blocks).reshape(upto - at, blocks)
        found = bounds >= least - 1e-4
        for k in np.flatnonzero(found.any(axis=1)):
            number = int(passage[begins[at + k]])
            doc = int(np.searchsorted(base, number, side="right")) - 1
            yield doc, (number - int(base[doc])) * step, term[begins[at + k] : ends[at + k]].tolist(), np.flatnonzero(found[k]).tolist()
        at = upto


def is_leak(question: float, answer: float, whole: float) -> bool:
    return (question >= 0.5 and answer >= 0.5) or question >= 0.9 or whole >= 0.5


def matches(texts: list[list[bytes]], index: Index, least: float, n: int) -> dict[tuple[int, int], tuple[bool, float, float, float, float]]:
    """(text, item): (leaked, question share, answer share, score, item share) of the best passage among those retrieved, leaked ones first."""
    out: dict[tuple[int, int], tuple[bool, float, float, float, float]] = {}
    for doc, start, terms, blocks in candidates(texts, index, least):
        words, held = texts[doc][start : start + 2 * index.longest], None
        for block in blocks:
            for item, score in index.search(terms, block, least):
                held = grams(words, n) if held is None else held
                question, answer, whole = (sum(g in held if len(g) == n else contains(words, g) for g in own) / len(own) if own else 1.0 for own in index.checks[item][1:])
                found = (is_leak(question, answer, whole), question, answer, score, whole)
                out[doc, item] = max(out.get((doc, item), found), found)
    return out


def contains(words: list[bytes], own: tuple) -> bool:
    """Whether own, shorter than an n-gram, stands in words."""
    return any(tuple(words[i : i + len(own)]) == own for i in range(len(words) - len(own) + 1))


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: float = 0.5, n: int = 5, shard_words: int = 50_000) -> DataFrame:
    """Rows (key, item, score, question_share, answer_share, item_share, leaked) of what was retrieved.

    leaked: some passage holds at least half of the question's n-grams and half of the answer's, or nine tenths of the question's alone, or half of
    the whole item's.
    """
    rows, impacts = postings(benchmark, item, item_text)
    total = rows.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    # An item goes to a shard by its hash; items of one text may share all their terms, so they are listed one by one.
    packed = impacts.groupBy("item", "text").agg(F.collect_list(F.struct("term", "impact")).alias("terms")).withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards)))
    packed = saved(packed)  # read once for each shard
    kinds = {f.name: f.dataType for f in docs.schema.fields} | {"item": benchmark.schema[item].dataType}
    schema = T.StructType([T.StructField(key, kinds[key]), T.StructField(item, kinds["item"]), *T.StructType.fromDDL("score double, question_share double, answer_share double, item_share double, leaked boolean").fields])
    asked = docs.select(key, text)
    parts = []
    for shard in range(shards):
        held = [(r["item"], r["text"], [(t["term"], t["impact"]) for t in r["terms"]]) for r in packed.where(F.col("shard") == shard).collect()]  # at most about shard_words words
        if held or shard == 0:
            parts.append(_search(asked, build(sorted(held, key=repr), n), schema, key, text, item, least, n))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _search(docs: DataFrame, index: Index, schema: T.StructType, key: str, text: str, item: str, least: float, n: int) -> DataFrame:
    # Plain values, so that workers that have no copy of this package can read them.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(index).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        index, names = Index(*shared.value), to_arrow_schema(schema)
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for part in slices(batch, text, 1 << 20):
                keys = part.column(key).to_pylist()
                texts = [words_of(t) if t else [] for t in part.column(text).to_pylist()]
                for (doc, i), (leaked, question, answer, score, whole) in matches(texts, index, least, n).items() if index.blocks else ():
                    for column, x in zip(out, (keys[doc], index.checks[i][0], score, question, answer, whole, leaked), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, names, strict=True)], names=schema.names)

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without those that hold a leaked item."""
    # Whether a text leaks hangs on it alone, so its digest can stand for an id that is null.
    name, id_, own = unused(docs, "_key", "_id", "_own")
    named = docs.withColumn(name, F.struct(F.col(key).alias("id"), F.when(F.col(key).isNull(), F.md5(text)).alias("own")))
    leaks = find(named, benchmark, name, text, **options).where("leaked").select(F.col(f"{name}.id").alias(id_), F.col(f"{name}.own").alias(own)).distinct()
    same = F.col(f"{name}.id").eqNullSafe(F.col(id_)) & F.col(f"{name}.own").eqNullSafe(F.col(own))
    return named.join(lookup(saved(leaks)), same, "left_anti").drop(name)
