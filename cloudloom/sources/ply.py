"""PLY clouds and meshes as DataFrames, and back.

Files come whole through Spark's own binary reader, so any store that Spark reads will do, and a file must fit a row (2 GB); header and rows are parsed by tasks, one for
each file. ASCII and both binary encodings are read. Columns: point_id (place in the file, from 0), x, y, z and, where the file has
them, r, g, b (0 to 1) and nx, ny, nz. Faces give tri_id, v0, v1, v2.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The format's type names.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
ORDER = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": ""}


def header(content: bytes) -> tuple[str, list[tuple[str, int, list[tuple]]], int]:
    """(format, [(element, count, properties)], where the rows start)."""
    end = content.index(b"end_header")
    start = content.index(b"\n", end) + 1
    kind, elements = "ascii", []
    for line in content[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append(tuple(words[1:]))
    if not content.startswith(b"ply") or kind not in ORDER:
        raise ValueError("not a PLY file")
    return kind, elements, start


def parse(content: bytes) -> dict[str, pd.DataFrame]:
    """Element name to its rows: columns by property; a list property is a column of arrays."""
    kind, elements, at = header(content)
    out = {}
    tokens = content[at:].split() if kind == "ascii" else None
    place = 0
    for name, count, properties in elements:
        if tokens is not None and not any(p[0] == "list" for p in properties):
            n = count * len(properties)
            values = np.array(tokens[place : place + n], dtype=float).reshape(count, len(properties))
            out[name] = pd.DataFrame(values, columns=[p[-1] for p in properties])
            place += n
        elif tokens is not None:
            rows = []
            for _ in range(count):
                row = []
                for p in properties:
                    n = int(tokens[place]) if p[0] == "list" else 1
                    place += p[0] == "list"
                    values = [float(x) for x in tokens[place : place + n]]
                    row.append([int(v) for v in values] if p[0] == "list" else values[0])
                    place += n
                rows.append(row)
            out[name] = pd.DataFrame(rows, columns=[p[-1] for p in properties])
        elif not any(p[0] == "list" for p in properties):
            layout = np.dtype([(p[1], ORDER[kind] + TYPES[p[0]]) for p in properties])
            data = np.frombuffer(content, layout, count, at)
            out[name] = pd.DataFrame({p: data[p].astype(float) for p in layout.names})
            at += count * layout.itemsize
        else:
            rows = []
            for _ in range(count):
                row = []
                for p in properties:
                    if p[0] == "list":
                        size = np.dtype(ORDER[kind] + TYPES[p[1]])
                        n = int(np.frombuffer(content, size, 1, at)[0])
                        at += size.itemsize
                        item = np.dtype(ORDER[kind] + TYPES[p[2]])
                        row.append(np.frombuffer(content, item, n, at).astype(int).tolist())
                        at += n * item.itemsize
                    else:
                        item = np.dtype(ORDER[kind] + TYPES[p[0]])
                        row.append(float(np.frombuffer(content, item, 1, at)[0]))
                        at += item.itemsize
                rows.append(row)
            out[name] = pd.DataFrame(rows, columns=[p[-1] for p in properties])
    return out


CLOUD = "path string, point_id long, x double, y double, z double, r double, g double, b double, nx double, ny double, nz double"


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """The vertices of the PLY files at path; r, g, b and nx, ny, nz are null where a file has none."""

    def rows(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                v = parse(content).get("vertex", pd.DataFrame(columns=["x", "y", "z"]))
                out = pd.DataFrame({"path": p, "point_id": np.arange(len(v))})
                for c in ("x", "y", "z", "nx", "ny", "nz"):
                    out[c] = v[c].astype(float) if c in v else np.nan
                for c, long in zip("rgb", ("red", "green", "blue"), strict=True):
                    out[c] = v[long] / 255 if long in v else np.nan
                yield out[["path", "point_id", "x", "y", "z", "r", "g", "b", "nx", "ny", "nz"]]

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, CLOUD)
    return out.select("path", "point_id", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz")])


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """tri_id, v0, v1, v2 of the PLY files at path; a mesh without triangles is refused when it is used as one."""

    def rows(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                faces = parse(content).get("face")
                lists = [] if faces is None else faces.iloc[:, 0].tolist()
                yield pd.DataFrame([(p, i, *f[:3]) for i, f in enumerate(lists)], columns=["path", "tri_id", "v0", "v1", "v2"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, tri_id long, v0 long, v1 long, v2 long")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of a .ply or .stl file."""
    if path.lower().endswith(".ply"):
        return read_cloud(spark, path)
    if path.lower().endswith(".stl"):
        return read_stl(spark, path).select("path", F.posexplode(F.array(*[F.struct(*[F.col(f"{a}{k}").alias(a) for a in "xyz"]) for k in range(3)])).alias("k", "v"), "tri_id").select("path", (F.col("tri_id") * 3 + F.col("k")).alias("point_id"), "v.*")
    raise ValueError(f"neither .ply nor .stl: {path}")


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of STL files, ASCII or binary: tri_id and the corners x0 to z2."""
    names = [f"{a}{k}" for k in range(3) for a in "xyz"]

    def rows(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                n = struct.unpack("<I", content[80:84])[0] if len(content) >= 84 else -1
                if len(content) == 84 + 50 * n:
                    data = np.frombuffer(content, np.dtype([("n", "<f4", 3), ("v", "<f4", 9), ("a", "<u2")]), n, 84)["v"].astype(float)
                else:
                    corners = [line.split()[1:4] for line in content.decode("ascii", "replace").splitlines() if line.split()[:1] == ["vertex"]]
                    data = np.array(corners, dtype=float).reshape(-1, 9)
                out = pd.DataFrame(data, columns=names)
                out.insert(0, "tri_id", np.arange(len(out)))
                out.insert(0, "path", p)
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, tri_id long, " + ", ".join(f"{c} double" for c in names))


def write_cloud(cloud: DataFrame, folder: str) -> None:
    """One ASCII PLY file for each partition, as text; a scan is the union of its parts, and point_id keeps the order."""
    colored = "r" in cloud.columns

    def lines(batches):
        rows = []
        for pdf in batches:
            for r in pdf.to_dict("records"):
                rows.append(f"{r['x']!r} {r['y']!r} {r['z']!r}" + (f" {round(r['r'] * 255)} {round(r['g'] * 255)} {round(r['b'] * 255)}" if colored else ""))
        head = ["ply", "format ascii 1.0", f"element vertex {len(rows)}", *[f"property double {a}" for a in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue") if colored], "end_header"]
        yield pd.DataFrame({"value": head + rows})

    columns = ["x", "y", "z", *(["r", "g", "b"] if colored else [])]
    cloud.sortWithinPartitions("point_id").select(*columns).mapInPandas(lines, "value string").write.text(folder)


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vertices (point_id, x, y, z) with nx, ny, nz: the sum of the cross products of their triangles, of length 1; null for vertices of none."""
    corner = lambda k: vertices.select(F.col("point_id").alias(f"v{k}"), *[F.col(a).alias(f"{a}{k}") for a in "xyz"])
    t = faces.join(corner(0), "v0").join(corner(1), "v1").join(corner(2), "v2")
    e = lambda k, a: F.col(f"{a}{k}") - F.col(f"{a}0")
    cross = {"nx": e(1, "y") * e(2, "z") - e(1, "z") * e(2, "y"), "ny": e(1, "z") * e(2, "x") - e(1, "x") * e(2, "z"), "nz": e(1, "x") * e(2, "y") - e(1, "y") * e(2, "x")}
    sums = t.withColumns(cross).select(F.explode(F.array("v0", "v1", "v2")).alias("point_id"), *cross).groupBy("point_id").agg(*[F.sum(c).alias(c) for c in cross])
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in cross), F.lit(0.0)))
    return vertices.drop(*cross).join(sums.withColumn("_l", length), "point_id", "left").withColumns({c: F.try_divide(F.col(c), F.col("_l")) for c in cross}).drop("_l")
