"""Names and settings of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Case tags, in the order in which they are looked for.
CASE_TAGS = ["SL_01", "LS_02", "LS_03", "VHS_04", "LS_05", "MS_06", "MS_07", "MS_09", "LS_09", "LS_10"]

#: Codes of the parts.
PART_CODES = {
    "body": "bdy", "front brake": "brk-frt", "rear brake": "brk-rr", "floor": "floor", "front wheel": "frt-whl", "rear wheel": "rr-whl",
    "front wing": "fw", "rear wing": "rw", "internal": "intnl", "front suspension": "susp-frt", "rear suspension": "susp-rr",
}


def part_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PART_CODES.items()), "part string, code string")


def case_tag(map_name: Column) -> Column:
    """The first tag, in the list's order, that the map's name holds."""
    return F.get(F.filter(F.array(*map(F.lit, CASE_TAGS)), lambda tag: F.contains(map_name, tag)), F.lit(0))


def case_number(tag: Column) -> Column:
    return F.split_part(tag, F.lit("_"), F.lit(2))


def map_conversion(map_name: Column) -> Column:
    """The third field of a map's name, or null."""
    return F.get(F.split(map_name, "_"), F.lit(2))


def file_name(model: Column, run: Column, map_name: Column, code: Column, condition: Column, notes: Column, fixed: str = "FV") -> Column:
    return F.concat_ws("_", model, run, F.lit(fixed), map_name, code, condition, F.nullif(F.trim(notes), F.lit("")))


def valid_name(name: Column) -> Column:
    return ~name.rlike("[\"']")


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields that are null or empty, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("")) == "", F.lit(n)) for n, c in fields.items()]))


def settings(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda s: F.trim(s).cast("double"))


def car_name(model: Column) -> Column:
    return F.concat(F.lit("C"), F.substring(model, 2, 1000))


def part_label(part: Column, what: str) -> Column:
    """A part's name, each word with a capital, and what was done with it."""
    return F.concat(F.initcap(part), F.lit(f" {what}"))


def with_extension(path: Column, old: str, new: str) -> Column:
    return F.replace(path, F.lit(old), F.lit(new))
