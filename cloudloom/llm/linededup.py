"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate and stay only once.

One aggregation over the MD5 of every line keeps the count, the first place and a HyperLogLog sketch of the sites; partial
sketches merge before and after the shuffle, so a line that a third of all documents hold costs each task one sketch. Lines
whose estimate lies near the threshold get exact distinct counts. Boilerplate keeps its first place (smallest doc_id, then
position) and is removed everywhere else. DataFrame functions only.

Defined results: a null text has no lines and stays null; an empty text keeps its empty line. Lines with fewer than
``min_words`` words are never boilerplate. A null site counts as a site of its own. Repeated rows of one doc_id count like
different places: the same line at the same place of the same doc_id is kept in each of these rows. Lines compare byte for
byte. Null ids come after all others and are told apart by their text; null ids with equal texts count as repeated rows of one. Extra columns pass through; the operator's own columns replace input columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import forget, lookup, saved, shared_folder, unmoved, unused

#: log2 of the sketch's registers, and the relative error of an estimate (1.04 / sqrt(registers)) times 4.
LG_K = 10
NEAR = 4 * 1.04 / 2 ** (LG_K / 2)


def _own(id_: str, text: str) -> Column:
    """What a row without an id is told by: the digest of its text. Null where there is an id."""
    return F.when(F.col(id_).isNull(), F.md5(text))


def _lines(docs: DataFrame, id_: str, text: str, site: str, min_words: int) -> DataFrame:
    """A row for each line that could be boilerplate: id, own (see _own), pos, site and the line's MD5."""
    # Found at a line's first words; the rest of it isn't read.
    enough = F.col("line").rlike("[\\x20\\x09-\\x0D]+".join(["[^\\x20\\x09-\\x0D]+"] * (min_words - 1) + ["[^\\x20\\x09-\\x0D]"]))
    return (
        docs.select(F.col(id_).alias("id"), _own(id_, text).alias("own"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .where(enough)
        .select("id", "own", "pos", "site", F.unhex(F.md5("line")).alias("key"))
    )


def spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """key and first place of the lines on min_sites sites or more."""
    found = lines.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "own", "pos")).alias("first"), F.hll_sketch_agg(F.xxhash64("site"), F.lit(LG_K)).alias("sketch")
    )
    # A line on fewer rows than min_sites can't be on as many sites.
    # Written, so that the joins below deal both sides anew and Spark can split a line that a third of all rows hold.
    rated = saved(found.where(F.col("n") >= min_sites).select("key", "first", F.hll_sketch_estimate("sketch").alias("sites")))
    low, high = min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1
    near = rated.where(F.col("sites").between(low, high))
    # Dealt by key and site, so the sites of a line that a third of all rows hold are made distinct in many tasks.
    pairs = lines.join(near.select("key"), "key").select("key", "site").repartition("key", "site").distinct()
    exact = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= min_sites)
    sure = rated.where(F.col("sites") > high).select("key", "first")
    return saved(sure.unionByName(near.join(exact, "key", "left_semi").select("key", "first")))


def dedup_lines(docs: DataFrame, id_: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 5, min_words: int = 3) -> DataFrame:
    """docs with the text less its repeated boilerplate lines, and n_lines and n_removed (long; 0 for a null text)."""
    docs = docs.drop("n_lines", "n_removed")
    id_of, own, places, parts = unused(docs, "_id", "_own", "_gone", "_parts")
    # Four steps read the lines; their keys are written once, a few bytes for each line.
    folder = shared_folder(docs.sparkSession)
    lines = saved(_lines(docs, id_, text, site, min_words), folder)
    known = spread(lines, min_sites)
    at_first = F.col("id").eqNullSafe(F.col("first.id")) & F.col("own").eqNullSafe(F.col("first.own")) & (F.col("pos") == F.col("first.pos"))
    gone = lines.join(known, "key").where(~at_first)
    # One row a document with the places to remove; a document's lines already share one row of the input.
    gone = gone.select(F.col("id").alias(id_of), F.col("own").alias(own), "pos").distinct().groupBy(id_of, own).agg(F.collect_list("pos").alias(places))
    # Texts are shuffled only where the places are too many for a broadcast.
    few = lookup(saved(gone), entries=F.size(places))
    forget(docs.sparkSession, folder)
    joined = docs.join(few, F.col(id_).eqNullSafe(F.col(id_of)) & _own(id_, text).eqNullSafe(F.col(own)), "left").withColumn(parts, F.split(text, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(places))
    return joined.withColumns({
        text: F.when(F.col(places).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")),
        "n_lines": F.coalesce(F.size(parts), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size(places), F.lit(0)).cast("long") + unmoved(),
    }).drop(id_of, own, places, parts)
