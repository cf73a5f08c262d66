"""Queries of session names; model, run and map texts are made of the customer table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions import naming
from cloudloom.sources.clouds import table

PARTS = list(naming.PART_CODES)


def sessions(s, d):
    c = table(s, d, "customer")
    key = F.col("c_custkey")
    tag = F.get(F.array(*map(F.lit, [*naming.CASE_TAGS, "none"])), F.pmod(key, F.lit(11)).cast("int"))
    return c.select(
        key, F.concat(F.lit("M"), F.pmod(key, F.lit(97)).cast("string")).alias("model"), F.when(key % 7 == 0, "").otherwise(key.cast("string")).alias("run"), F.concat(F.col("c_mktsegment"), F.lit("_"), tag, F.lit("_C"), key.cast("string")).alias("map"),
        F.get(F.array(*map(F.lit, PARTS)), F.pmod(key, F.lit(len(PARTS))).cast("int")).alias("part"), F.when(key % 3 == 0, "loaded").when(key % 3 == 1, "").otherwise("straightline").alias("condition"), F.when(key % 5 == 0, "  ").otherwise(F.col("c_name")).alias("notes"),
    )


def _names(s, d):
    t = sessions(s, d).join(F.broadcast(naming.part_codes(s)), "part")  # eleven rows
    return t.select("c_custkey", naming.file_name(F.col("model"), F.col("run"), F.col("map"), F.col("code"), F.col("condition"), F.col("notes")).alias("name"))


def _missing(s, d):
    fields = {"Model": F.col("model"), "Run": F.col("run"), "Map": F.col("map"), "Part": F.col("part"), "Load Condition": F.col("condition")}
    return sessions(s, d).select("c_custkey", F.array_join(naming.missing_fields(fields), ",").alias("missing"))


def _settings(s, d):
    text = F.concat_ws(", ", F.lit("20"), (F.col("c_custkey") % 50).cast("string"), F.lit("30.5"))
    return sessions(s, d).select("c_custkey", F.aggregate(naming.settings(text), F.lit(0.0), lambda a, b: a + b).alias("total"))


QUERIES = {
    "compose_names": _names,
    "case_tags": lambda s, d: sessions(s, d).select("c_custkey", naming.case_tag(F.col("map")).alias("tag"), naming.case_number(naming.case_tag(F.col("map"))).alias("number")),
    "map_conversion": lambda s, d: sessions(s, d).select("c_custkey", naming.map_conversion(F.col("map")).alias("conversion")),
    "missing_fields": _missing,
    "parse_settings": _settings,
    "valid_names": lambda s, d: sessions(s, d).select("c_custkey", naming.valid_name(F.concat(F.col("model"), F.when(F.col("c_custkey") % 4 == 0, "'").otherwise(""))).alias("valid")),
    "car_labels": lambda s, d: sessions(s, d).select("c_custkey", naming.car_name(F.col("model")).alias("car"), naming.part_label(F.col("part"), "flowviz test").alias("label"), naming.with_extension(F.concat(F.col("model"), F.lit(".ply")), ".ply", "_registered.ply").alias("path")),
    "name_checksums": lambda s, d: sessions(s, d).select("c_custkey", F.sha1(F.col("map").cast("binary")).alias("sha1"), F.format_string("<file>%s</file>", F.col("map")).alias("xml")),
    "numeric_file_order": lambda s, d: sessions(s, d).select(F.regexp_extract("map", "C(\\d+)$", 1).cast("int").alias("number"), "map").orderBy("number"),
}

_LIST = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
_CODES = "CASE part " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in naming.PART_CODES.items()) + " END"
_T = f"""(SELECT c_custkey, 'M' || c_custkey % 97 AS model, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_custkey::VARCHAR END AS run, c_mktsegment || '_' || list_extract({_LIST([*naming.CASE_TAGS, 'none'])}, c_custkey % 11 + 1) || '_C' || c_custkey AS map,
 list_extract({_LIST(PARTS)}, c_custkey % {len(PARTS)} + 1) AS part, CASE WHEN c_custkey % 3 = 0 THEN 'loaded' WHEN c_custkey % 3 = 1 THEN '' ELSE 'straightline' END AS condition, CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE c_name END AS notes FROM customer)"""
_TAG = f"list_filter({_LIST(naming.CASE_TAGS)}, lambda t: contains(map, t))[1]"

SQL = {
    "compose_names": f"SELECT c_custkey, concat_ws('_', model, run, 'FV', map, {_CODES}, condition, nullif(trim(notes), '')) AS name FROM {_T}",
    "case_tags": f"SELECT c_custkey, {_TAG} AS tag, split_part({_TAG}, '_', 2) AS number FROM {_T}",
    "map_conversion": f"SELECT c_custkey, string_split(map, '_')[3] AS conversion FROM {_T}",
    "missing_fields": f"SELECT c_custkey, concat_ws(',', CASE WHEN model = '' THEN 'Model' END, CASE WHEN run = '' THEN 'Run' END, CASE WHEN map = '' THEN 'Map' END, CASE WHEN part = '' THEN 'Part' END, CASE WHEN condition = '' THEN 'Load Condition' END) AS missing FROM {_T}",
    "parse_settings": "SELECT c_custkey, 50.5::DOUBLE + c_custkey % 50 AS total FROM customer",
    "valid_names": "SELECT c_custkey, c_custkey % 4 <> 0 AS valid FROM customer",
    "car_labels": f"SELECT c_custkey, 'C' || substr(model, 2) AS car, list_aggregate(list_transform(string_split(part, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') || ' flowviz test' AS label, model || '_registered.ply' AS path FROM {_T}",
    "name_checksums": f"SELECT c_custkey, sha1(map) AS sha1, '<file>' || map || '</file>' AS xml FROM {_T}",
    "numeric_file_order": f"SELECT c_custkey::INT AS number, map FROM {_T}",
}
