"""PLY clouds as a Spark data source: spark.read.format("ply").load(folder) and df.write.format("ply").save(folder), once register(spark) was called.

The vertices of a binary file have one size, so a file is read in ranges of vertices by as many tasks as it takes (option rangeBytes, 32 MB); only its header is read to plan
them. A file of text, or with lists before its vertices, is one task's. Files are opened through Arrow's file systems, so paths may be local or in a store that these know.
Columns as in ply.CLOUD. Writing gives one binary file for each partition, with colours as bytes and normals where the columns are there; a cloud is the union of its files.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from cloudloom.sources.ply import CLOUD, ORDER, TYPES, header, parse

RANGE, MOST_HEADER, ROWS = 32 << 20, 1 << 20, 1 << 16
_NAMES = {"x": "x", "y": "y", "z": "z", "nx": "nx", "ny": "ny", "nz": "nz", "r": "red", "g": "green", "b": "blue"}


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _head(system: fs.FileSystem, path: str) -> bytes:
    """The start of a file, up to where its rows begin and perhaps a little more."""
    with system.open_input_file(path) as f:
        content, size = b"", min(f.size(), MOST_HEADER)
        while b"end_header" not in content[:-32] and len(content) < size:
            content += f.read(min(4096, size - len(content)))
    return content


@dataclass
class Vertices(InputPartition):
    """Some vertices of a file: from first on, count of them; count None: all of a file that has to be read whole."""

    path: str
    first: int
    count: int | None


class PlyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[InputPartition]:
        system, path = store(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        out: list[InputPartition] = []
        for f in sorted((f for f in files if f.type == fs.FileType.File and f.path.lower().endswith(".ply")), key=lambda f: f.path):
            kind, elements, _ = header(_head(system, f.path))
            if kind == "ascii" or not elements or elements[0][0] != "vertex" or any(p[0] == "list" for p in elements[0][2]):
                out.append(Vertices(f.path, 0, None))
                continue
            each = max(1, self.range // max(1, self.layout(kind, elements).itemsize))
            out += [Vertices(f.path, k, min(each, elements[0][1] - k)) for k in range(0, elements[0][1], each)]
        return out

    @staticmethod
    def layout(kind: str, elements: list) -> np.dtype:
        return np.dtype([(p[1], ORDER[kind] + TYPES[p[0]]) for p in elements[0][2]])

    def read(self, part: Vertices) -> Iterator[pa.RecordBatch]:
        system, _ = store(self.path)
        with system.open_input_file(part.path) as f:
            if part.count is None:
                v = parse(f.read()).get("vertex")
                columns = {} if v is None else {c: v[c].to_numpy(float) for c in v.columns if v[c].dtype != object}
                if columns:
                    yield self.batch(part.path, 0, columns)
                return
            head = f.read(min(f.size(), MOST_HEADER))
            kind, elements, start = header(head)
            layout = self.layout(kind, elements)
            for k in range(part.first, part.first + part.count, ROWS):
                n = min(ROWS, part.first + part.count - k)
                f.seek(start + k * layout.itemsize)
                data = np.frombuffer(f.read(n * layout.itemsize), layout, n)
                yield self.batch(part.path, k, {c: data[c].astype(float) for c in layout.names})

    @staticmethod
    def batch(path: str, first: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        out = [pa.array([path] * n, pa.string()), pa.array(np.arange(first, first + n))]
        names = ["x", "y", "z", "r", "g", "b", "nx", "ny", "nz"]
        for c in names:
            own = columns.get(_NAMES[c])
            out.append(pa.nulls(n, pa.float64()) if own is None else pa.array(own / 255 if c in "rgb" else own))
        return pa.RecordBatch.from_arrays(out, names=["path", "point_id", *names])


@dataclass
class Written(WriterCommitMessage):
    path: str


class PlyWriter(DataSourceArrowWriter):
    """Each task writes a file under a name of its own; those of failed tasks are deleted, and so are older files once all is written, if asked to overwrite."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex
        self.columns = [c for c in ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b") if c in schema.names]
        if not {"x", "y", "z"} <= set(self.columns):
            raise ValueError("a cloud needs x, y and z")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = store(self.path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/part-{self.run}-{uuid.uuid4().hex}.ply"
        layout = np.dtype([(_NAMES[c], "u1" if c in "rgb" else "<f8") for c in self.columns])
        # The number of rows stands in the header, at a fixed width, and is known in the end: rows go to a part first.
        body, n = f"{name}.rows", 0
        with system.open_output_stream(body) as f:
            for batch in batches:
                rows = np.zeros(batch.num_rows, layout)
                for c in self.columns:
                    own = batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
                    rows[_NAMES[c]] = np.clip(np.rint(np.nan_to_num(own) * 255), 0, 255) if c in "rgb" else own
                f.write(rows.tobytes())
                n += batch.num_rows
        head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *[f"property {'uchar' if c in 'rgb' else 'double'} {_NAMES[c]}" for c in self.columns], "end_header", ""]
        with system.open_output_stream(name) as f, system.open_input_stream(body) as rows:
            f.write("\n".join(head).encode())
            while block := rows.read(1 << 20):
                f.write(block)
        system.delete_file(body)
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.overwrite:
            self._delete({m.path for m in messages if m})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._delete(set(), f"part-{self.run}-")

    def _delete(self, kept: set[str], start: str = "part-") -> None:
        system, folder = store(self.path)
        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.path not in kept and f.base_name.startswith(start) and f.type == fs.FileType.File:
                system.delete_file(f.path)


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return CLOUD

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlyReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PlyWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format "ply" known to a session."""
    spark.dataSource.register(PlySource)


def save_registered(cloud, folder: str, name: str, factor: float = 1 / 600) -> None:
    """A registered cloud twice, as folders of PLY files: <name>_registered, and <name>_registered_paraview scaled about the origin."""
    from cloudloom.functions.geometry import scale

    register(cloud.sparkSession)
    for rows, suffix in ((cloud, "registered"), (scale(cloud, factor), "registered_paraview")):
        rows.write.format("ply").mode("overwrite").save(f"{folder.rstrip('/')}/{name}_{suffix}")
