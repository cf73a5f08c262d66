"""Language of the words of code-switched text: a linear-chain conditional random field, labelled by forward-backward.

Emission scores come from affix, character n-gram and lexicon features of a word, hashed to a fixed width; transition scores
are learned beside them. The lexicon holds the words that two sampled documents of a language share. Training texts carry one language each, so training sequences are made by joining runs of words of
different documents: the transitions then learn how seldom a language changes. A document's language is the one with the
largest sum of word posteriors, its score that language's mean posterior.

The model is fitted on a bounded sample of labelled rows: ``most_docs`` for each language, and of each document a stretch of ``doc_words`` words at a
place that a hash of its key chooses. Prediction covers every word of every text; a run of more than 60 letters counts as several words of up to 60.

Defined results: a null text, or one without letters, gives ``und`` and score 0. With no labelled row at all every text is
``und``. Ties go to the language that sorts first. Rows are labelled one by one, so repeated rows get equal results; an empty table gives an empty
result; extra columns pass through and columns named like the output are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm.common import SPACES, slices
from cloudloom.llm.shingles import mixed

WIDTH = 1 << 16
#: Words that an executor's table of emission scores holds before it starts anew.
MOST_KNOWN = 200_000
#: Letters, and numbers that aren't decimal digits; those by themselves are no word.
RUNS = re.compile(r"[^\W\d_]{1,60}")


def words_of(text: str) -> list[str]:
    return [w for w in RUNS.findall(text.lower()) if has_letter(w)]


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def features(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of a word, feature) of all words' features: affixes of 1 to 4 letters, inner bigrams and trigrams with marked ends, the word itself, and the languages whose lexicon has it."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin, end = np.cumsum(sizes + 2) - (sizes + 2), np.cumsum(sizes + 2)
    word = np.repeat(np.arange(len(words)), sizes + 2)
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def add(who: np.ndarray, start: np.ndarray, length: int, kind: int) -> None:
        h = np.full(len(start), kind, np.uint64)
        for j in range(length):
            h = mixed(h + codes[start + j] * np.uint64(0x9E3779B97F4A7C15))
        out.append((who, h))

    with np.errstate(over="ignore"):
        for n in (2, 3):
            at = np.flatnonzero(np.arange(len(codes)) + n <= end[word]) if len(words) else np.zeros(0, np.int64)
            add(word[at], at, n, n)
        for n in range(1, 5):
            long = np.flatnonzero(sizes >= n)
            add(long, begin[long] + 1, n, 10 + n)
            add(long, end[long] - 1 - n, n, 20 + n)
        place = (np.arange(len(codes)) - begin[word]).astype(np.uint64)
        own = mixed(codes * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xD6E8FEB86659FD93))
        out.append((np.arange(len(words)), mixed(np.add.reduceat(own, begin)) if len(words) else np.zeros(0, np.uint64)))
    known = [(k, lang) for k, w in enumerate(words) for lang in lexicon.get(w, ())]
    out.append((np.array([k for k, _ in known], np.int64), mixed(np.array([1000 + lang for _, lang in known], np.uint64))))
    return np.concatenate([x for x, _ in out]), (np.concatenate([x for _, x in out]) % np.uint64(WIDTH)).astype(np.int64)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # WIDTH x labels
    moves: np.ndarray  # labels x labels
    start: np.ndarray
    lexicon: dict[str, tuple[int, ...]]

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of the words' scores, the largest of each word being 1."""
        who, feature = features(words, self.lexicon)
        scores = np.stack([np.bincount(who, self.weights[feature, k], len(words)) for k in range(len(self.labels))], axis=1)
        return np.exp(scores - scores.max(axis=1, keepdims=True))


def forward_backward(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray, paired: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the words of sequences whose emissions lie one after another in emit; paired: also the summed pair posteriors.

    Sequences are taken longest first, and step t handles the t-th word of all that are long enough, so a batch costs as many
    vector steps as its longest sequence has words.
    """
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    most = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(most), side="left").tolist()  # sequences with more than t words
    move = np.exp(moves)
    alpha, beta = np.empty_like(emit), np.empty_like(emit)
    now = None
    for t in range(most):
        at = begins[: active[t]] + t
        now = emit[at] * (np.exp(start) if t == 0 else now[: active[t]] @ move)
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    pairs = np.zeros_like(moves)
    now = np.ones((0, len(start)))
    for t in range(most - 1, -1, -1):
        at, after = begins[: active[t]] + t, len(now)
        if after:
            onward = emit[at[:after] + 1] * now
            now = onward @ move.T
            now /= now.sum(axis=1, keepdims=True)
            if paired:
                left = alpha[at[:after]]
                norm = ((left @ move) * onward).sum(axis=1, keepdims=True)
                pairs += (left / norm).T @ onward * move
        if after < len(at):
            now = np.concatenate([now, np.ones((len(at) - after, len(start)))])
        beta[at] = now
    alpha *= beta
    return alpha / alpha.sum(axis=1, keepdims=True), pairs


def fit(rows: list[tuple[str, str]], most_words: int = 120, sequences: int = 1200, steps: int = 60, rate: float = 0.2, decay: float = 1e-4, seed: int = 7) -> Model | None:
    """A model from (text, language) rows: full-batch Adam on the conditional likelihood of made-up sequences of up to most_words words."""
    labels = sorted({lang for _, lang in rows})
    docs = [(words_of(text), labels.index(lang)) for text, lang in sorted(rows)]
    docs = [x for x in docs if x[0]]
    if not docs:
        return None
    seen_in = Counter((w, lang) for found, lang in docs for w in set(found))
    lexicon: dict[str, tuple[int, ...]] = {}
    for w, lang in sorted(x for x, n in seen_in.items() if n > 1):
        lexicon[w] = (*lexicon.get(w, ()), lang)
    draw = np.random.default_rng(seed)
    ids: dict[str, int] = {}
    words, tags, lengths = [], [], []
    for _ in range(sequences):
        own, want = 0, int(draw.integers(10, most_words))
        while own < want:
            tokens, tag = docs[draw.integers(len(docs))]
            n = int(min(draw.integers(5, 60), want - own, len(tokens)))
            at = int(draw.integers(0, len(tokens) - n + 1))
            words += [ids.setdefault(w, len(ids)) for w in tokens[at : at + n]]
            tags += [tag] * n
            own += n
        lengths.append(own)
    words, tags, lengths = np.array(words), np.array(tags), np.array(lengths)
    (of, flat), n = features(list(ids), lexicon), len(labels)
    truth, firsts = np.eye(n)[tags], np.cumsum(lengths) - lengths
    inside = np.ones(len(words), bool)
    inside[firsts] = False
    at = np.flatnonzero(inside)
    seen = np.zeros((n, n))
    np.add.at(seen, (tags[at - 1], tags[at]), 1)
    params = [np.zeros((WIDTH, n)), np.zeros((n, n)), np.zeros(n)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        scores = np.stack([np.bincount(of, params[0][flat, k], len(ids)) for k in range(n)], axis=1)
        emit = np.exp(scores - scores.max(axis=1, keepdims=True))
        posterior, pairs = forward_backward(emit[words], lengths, params[1], params[2], paired=True)
        error = posterior - truth
        by_word = np.stack([np.bincount(words, error[:, k], len(ids)) for k in range(n)], axis=1)
        grads = [np.stack([np.bincount(flat, by_word[of, k], WIDTH) for k in range(n)], axis=1), pairs - seen, error[firsts].sum(axis=0)]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g = g / len(words) + decay * p
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(labels, params[0].astype(np.float32), params[1], params[2], lexicon)


def sample(docs: DataFrame, text: str, lang: str, key: str, most_docs: int, doc_words: int) -> list[tuple[str, str]]:
    """About most_docs labelled texts of each language, chosen by a hash of the key, doc_words words of each: a bounded number whatever the input's size."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # a row for each language
    if not counts:
        return []
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, most_docs / n))]), F.col(lang))
    chosen = known.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) / 1_000_003 < share)
    words = chosen.select(F.split(F.translate(text, SPACES, " "), " +").alias("words"), lang, F.xxhash64(F.lit("place"), key).alias("place"))
    at = F.pmod("place", F.greatest(F.size("words") - doc_words + 1, F.lit(1))).cast("int") + 1
    rows = words.select(F.array_join(F.slice("words", at, doc_words), " ").alias("text"), lang)
    return [(r[0], r[1]) for r in rows.limit(2 * most_docs * len(counts)).collect()]


class Known(dict):
    """Numbers of the words met so far; -1 for those without a letter. fresh: those that have no emissions yet."""

    def __init__(self):
        super().__init__()
        self.n, self.fresh = 0, []

    def __missing__(self, word: str) -> int:
        if not has_letter(word):
            self[word] = -1
            return -1
        self[word] = self.n
        self.n += 1
        self.fresh.append(word)
        return self.n - 1


class Labeller:
    """Labels slices of texts and remembers the emissions of words."""

    def __init__(self, model: Model):
        self.model, self.known, self.emit = model, Known(), np.zeros((0, len(model.labels)))

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of all words of the texts, and how many words each text has."""
        if len(self.known) > MOST_KNOWN:
            self.known, self.emit = Known(), self.emit[:0]
        ids, ends = [], []
        for text in texts:
            if text:
                ids.extend(map(self.known.__getitem__, RUNS.findall(text.lower())))
            ends.append(len(ids))
        if self.known.fresh:
            self.emit = np.concatenate([self.emit, self.model.emissions(self.known.fresh)])
            self.known.fresh = []
        ids, lengths = np.array(ids, np.int64), np.diff(ends, prepend=0)
        words = ids >= 0
        if not words.all():
            lengths = np.bincount(np.repeat(np.arange(len(texts)), lengths)[words], minlength=len(texts))
            ids = ids[words]
        if not len(ids):
            return np.zeros((0, len(self.model.labels))), lengths
        posterior, _ = forward_backward(self.emit[ids], lengths[lengths > 0], self.model.moves, self.model.start)
        return posterior, lengths


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, and word_counts: how many words each language got, in the order of the model's labels."""
    docs = docs.drop("lang_pred", "score", "word_counts")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("word_counts", T.ArrayType(T.LongType()))])
    # Plain values, of bounded size like the sample: workers that have no copy of this package can read them.
    shared = docs.sparkSession.sparkContext.broadcast(model and tuple(vars(model).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value and Model(*shared.value)
        n, labeller = len(model.labels) if model else 0, model and Labeller(model)
        for batch in batches:
            for part in slices(batch, text):
                preds, scores, counts = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros((part.num_rows, n), np.int64)
                if model:
                    posterior, lengths = labeller.posteriors(part.column(text).to_pylist())
                    rows = np.flatnonzero(lengths)
                    if len(rows):
                        begins = np.cumsum(lengths[rows]) - lengths[rows]
                        sums = np.add.reduceat(posterior, begins, axis=0)
                        best = sums.argmax(axis=1)
                        scores[rows] = np.minimum(1.0, sums[np.arange(len(rows)), best] / lengths[rows])
                        counts[rows] = np.add.reduceat(np.eye(n, dtype=np.int64)[posterior.argmax(axis=1)], begins, axis=0)
                        for r, b in zip(rows, best, strict=True):
                            preds[r] = model.labels[b]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(preds, pa.string()), pa.array(scores), pa.array(counts.tolist(), pa.list_(pa.int64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """True for the quarter of documents that training leaves out: crc32 of the id as text is 2 modulo 4."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most_docs: int = 300, doc_words: int = 400) -> Model | None:
    """A model from the labelled documents that aren't held out."""
    return fit(sample(docs.where(~held_out(key)), text, lang, key, most_docs, doc_words))
