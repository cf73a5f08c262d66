"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import decontaminate, jaccard, langid, licenses, linededup, oracles, periodic, pieces, quality, secrets, simhash, toolcalls, variants
from cloudloom.llm.common import SPACES, read


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(read(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "line", "word", "place", F.md5("candidate").alias("candidate_md5"), F.round("score", 6).alias("score"), "secret")


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.cluster(read(spark, folder, "documents").select("doc_id", "text"))


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    calls, results = toolcalls.calls_of(read(spark, folder, "conversations"))
    out = toolcalls.link(calls, results, toolcalls.SCHEMAS)
    return out.select(F.col("conversation").alias("conv_id"), "n_calls", "n_linked", "n_orphans", "n_invalid", F.array_join("call_order", ",").alias("call_order"), F.md5("json").alias("json_md5"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.find(docs, read(spark, folder, "benchmark")).where("leaked").select("doc_id", "item_id", F.round("score", 6).alias("score"), "question_share", "answer_share")


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "source")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(read(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("notices").cast("long").alias("n_notices"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return quality.rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return pieces.token_counts(docs, pieces.load()).select("doc_id", "n_tokens", "token_score")


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, pieces.load(), verify=True)
    return coded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), "lossless")


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.cluster(read(spark, folder, "documents").select("doc_id", "text"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.group(variants.counts(read(spark, folder, "documents").select("doc_id", "text"), every=199))


def _with_repeats(id_: Column, text: Column) -> Column:
    """The text of op13's contract: of every tenth document (by crc32 of its id) the words from one place on are the first few of them over and over."""
    h = F.crc32(id_.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        start = (g % n).cast("int")
        period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
        times = F.ceil((n - start) / period).cast("int")
        return F.array_join(F.concat(F.slice(words, 1, start), F.slice(F.flatten(F.array_repeat(F.slice(words, start + 1, period), times)), 1, n - start)), " ")

    trimmed = F.btrim(text, F.lit(SPACES))
    # A list of one list gives its words a name, so they are split once.
    words = F.array(F.split(trimmed, "[ \\t\\n\\x0b\\f\\r]+"))
    return F.when((h % 10 == 0) & (trimmed != ""), F.get(F.transform(words, repeated), F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", _with_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.scan(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.short")
    return out.select("doc_id", "n_runs", (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries():
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_chat_format": op3_chat_format,
        "op4_decontamination": op4_decontamination,
        "op5_line_dedup": op5_line_dedup,
        "op6_license_scan": op6_license_scan,
        "op7_quality_rules": op7_quality_rules,
        "op8_token_counts": op8_token_counts,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_language_id": op10_language_id,
        "op11_simhash_dedup": op11_simhash_dedup,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql():
    return {
        "op3_chat_format": oracles.CHAT_FORMAT,
        "op5_line_dedup": oracles.LINE_DEDUP,
        "op7_quality_rules": oracles.quality_rules(),
    }
