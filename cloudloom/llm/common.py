"""Helpers that the text operators share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.sources.shared import Workspace, forget, saved, shared_folder  # noqa: F401

#: The separators of words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def unmoved() -> Column:
    """0, of which the optimizer can't tell that it is: a projection that adds it isn't merged into filters above it. Else these would
    repeat its expressions, inside lambdas once for each element."""
    return F.floor(F.rand(0)).cast("long")


def lookup(table: DataFrame, most_rows: int = 1_000_000, entries: Column | None = None) -> DataFrame:
    """table, a written one with a few numbers a row, hinted to be broadcast if it is counted to have most_rows rows at most; beyond that, joins with it shuffle.

    entries: how many numbers a row's list holds, if it has one; then these are counted, with one for the row."""
    n = table.count() if entries is None else table.agg(F.sum(entries + 1)).first()[0] or 0
    return F.broadcast(table) if n <= most_rows else table


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names for an operator's own columns: those given, with as many underscores more as it takes to differ from all of docs, whatever their case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about most_bytes of text each; a longer single text is a part of its own."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def vocabulary_file(name: str) -> str:
    """Place of a public tokenizer file; the folder is a parameter (CLOUDLOOM_TOKENIZERS), /opt/tokenizers unless given."""
    return os.path.join(os.environ.get("CLOUDLOOM_TOKENIZERS", "/opt/tokenizers"), name)
