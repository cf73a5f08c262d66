"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression over the text; no user function runs. The repeated 5-word windows of a text are
found inside its own row, by sorting hashes, only for the texts that have any.

Defined results: a null or empty text has no words, all measures 0, fails the base rule and isn't kept. Rows are judged one
by one, so repeated rows get the same verdict and an empty table gives an empty result. Extra input columns are passed
through by ``rules``; its own columns replace input columns of the same names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import SPACES, unmoved

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as are be this was by at or from "
    "le la les de des et un une que qui dans en du pour par sur au avec est pas "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als "
    "el y a los del se las con no una su al lo para"
).split()

#: (name, numerator, denominator, least, most, from how many words on); a measure outside [least, most] rejects.
RULES = [
    ("mean_word_length", "word_chars", "n_words", 2.0, 14.0, 1),
    ("symbol_ratio", "n_symbols", "word_chars", None, 0.05, 1),
    ("stop_word_ratio", "n_stop_words", "n_words", 0.05, None, 30),
    ("capital_ratio", "n_capitals", "word_chars", None, 0.6, 30),
    ("exclamation_ratio", "n_exclamations", "n_words", None, 0.5, 10),
    ("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5, 10),
]


def _erased(text: Column, chars: str) -> Column:
    """Number of characters of text that are in chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and the counts that the rules use."""
    t = F.coalesce(F.col(text), F.lit(""))
    space = "[\\x20\\x09-\\x0D]"
    own = ["_w", "_lines", "_grams", "_at", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_capitals", "n_exclamations"]
    # An empty first or last piece comes from a separator at either end; inside there is none, as separators are taken in runs.
    first = docs.drop(*own).withColumns({
        "_w": F.filter(F.split(t, f"{space}+"), lambda w: w != ""),
        "_lines": F.filter(F.split(t, "\n"), lambda line: F.translate(line, SPACES, "") != ""),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": _erased(t, "#*$%&|<>").cast("long"),
        "n_capitals": _erased(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
        "n_exclamations": _erased(t, "!").cast("long"),
    })
    word = lambda i: F.get("_w", i)
    second = first.withColumns({
        "n_words": F.size("_w").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        "_grams": F.when(F.size("_w") > window, F.transform(F.sequence(F.lit(0), F.size("_w") - window), lambda i: F.xxhash64(*[word(i + k) for k in range(window)]))),
    })
    third = second.withColumn("_grams", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    at = lambda i: F.get("_grams", i).getField("g")
    fourth = third.withColumn("_at", F.sort_array(F.transform(F.filter("_grams", lambda x, i: (x.g == at(i - 1)) | (x.g == at(i + 1))), lambda x: x.i)))
    # A window covers `window` words from its start on, or as many as there are up to the next repeated window.
    covered = F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("_at", i + 1) - p, F.lit(window)))), F.lit(0), lambda a, b: a + b)
    return fourth.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long") + unmoved()).drop("_w", "_lines", "_grams", "_at")


def verdict(rules: list[tuple] = RULES) -> Column:
    """The rules as one boolean expression over the measures: true where none rejects."""

    def passes(rule: tuple) -> Column:
        _, top, bottom, least, most, words = rule
        value = F.col(top) / F.greatest(F.col(bottom), F.lit(1))
        bounds = [value >= least] * (least is not None) + [value <= most] * (most is not None)
        return (F.col("n_words") < words) | reduce(Column.__and__, bounds)

    return reduce(Column.__and__, map(passes, rules), F.lit(True))


def rules(docs: DataFrame, text: str = "text", table: list[tuple] = RULES) -> DataFrame:
    """docs with the measures, base_failed (under 10 words, or over a fifth of the words in repeated windows) and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(table))
