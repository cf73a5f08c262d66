"""Nearest points by leaves: points and queries are dealt to boxes of about LEAF points each, and no pair of points is ever shuffled but those that a query finds in several boxes.

The boxes are the leaves of a tree that halves a bounded sample of the points, so that they are small where points are dense. First each query is answered in its own
leaf, which bounds how far its k nearest can lie and so which other leaves can hold one (``reaches``). Then it looks into these leaves alone (``gathered``). Both are exact;
the sample only decides where boxes end. Of points at one place the k with the smallest ids stand for all, as no other can be among anybody's k nearest; a leaf that
many queries lie in is copied. Points and queries without finite coordinates have no place: they find nothing and aren't found.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.sources.shared import saved

#: Points of a leaf, about; leaves at most, as a power of 2; rows of the sample for each leaf; queries of a leaf that share a copy of it.
LEAF, MOST_DEPTH, SAMPLE, ASKERS = 8192, 12, 32, 32768
#: Tasks of a step at most.
MOST_TASKS = 1024
#: Points of a bucket inside a leaf, and queries answered at once.
BUCKET, TOGETHER = 64, 64
SLACK = 1 + 1e-9


class Tree:
    """Where leaves part: a full binary tree, split at medians along the widest axis."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, inner = depth, (1 << depth) - 1
        self.axis, self.at = np.zeros(inner, np.int64), np.full(inner, np.inf)
        own = {0: np.arange(len(sample))}
        for node in range(inner):
            rows = own.pop(node)
            if len(rows):
                self.axis[node] = np.ptp(sample[rows], axis=0).argmax()
                values = sample[rows, self.axis[node]]
                self.at[node] = np.median(values)
                right = values >= self.at[node]
                own[2 * node + 1], own[2 * node + 2] = rows[~right], rows[right]
            else:
                own[2 * node + 1], own[2 * node + 2] = rows, rows

    def leaf(self, at: np.ndarray) -> np.ndarray:
        node = np.zeros(len(at), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (at[np.arange(len(at)), self.axis[node]] >= self.at[node])
        return node - len(self.axis)


def buckets(at: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of at in parts of up to most, halved along the widest axis."""
    out, open_ = [], [np.arange(len(at))]
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            out += [rows] * bool(len(rows))
            continue
        values = at[rows, np.ptp(at[rows], axis=0).argmax()]
        order = np.argpartition(values, len(rows) // 2)
        open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """The least distance of boxes (rows of low, high) from others (rows of lows, highs)."""
    gaps = np.maximum(np.maximum(lows[None] - high[:, None], low[:, None] - highs[None]), 0.0)
    return np.sqrt(np.square(gaps).sum(axis=2))


def representatives(ids: pa.Array, at: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k smallest ids at each place, in the order of their ids."""
    order = pc.sort_indices(ids).to_numpy()
    own = at[order]
    by = np.lexsort([np.arange(len(own)), *own.T])
    new = np.append(True, (own[by][1:] != own[by][:-1]).any(axis=1)) if len(by) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    first = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by)))) < k
    return order[np.sort(by[first])]


def distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(reduce(np.add, [(q[:, None, i] - p[None, :, i]) * (q[:, None, i] - p[None, :, i]) for i in range(q.shape[1])]))


class Leaf:
    """The points of a leaf, in the order of their ids, in buckets."""

    def __init__(self, at: np.ndarray):
        self.at, self.parts = at, buckets(at, BUCKET)
        self.sizes = np.array([len(x) for x in self.parts], np.int64)
        self.low, self.high = (np.array([f(at[x], axis=0) for x in self.parts]).reshape(-1, at.shape[1]) for f in (np.min, np.max))

    def near(self, q: np.ndarray, far: float, gaps: np.ndarray) -> np.ndarray:
        """Points of the buckets that aren't farther than far."""
        found = [self.parts[i] for i in np.flatnonzero(gaps <= far * SLACK)]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def bounds(self, q: np.ndarray, k: int) -> np.ndarray:
        """How far each query's k-th nearest point of the leaf is; infinite where there are fewer."""
        if len(self.at) < k:
            return np.full(len(q), np.inf)
        gaps = apart(q.min(axis=0)[None], q.max(axis=0)[None], self.low, self.high)[0]
        order = np.argsort(gaps)
        some = order[: np.searchsorted(np.cumsum(self.sizes[order]), k) + 1]
        first = np.partition(distances(q, self.at[np.concatenate([self.parts[i] for i in some])]), k - 1, axis=1)[:, k - 1]
        return np.partition(distances(q, self.at[self.near(q, first.max(), gaps)]), k - 1, axis=1)[:, k - 1]

    def lists(self, q: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, d, place) of each query's k nearest points within its own distance far, in order."""
        gaps = apart(q.min(axis=0)[None], q.max(axis=0)[None], self.low, self.high)[0]
        rows = self.near(q, far.max(), gaps)
        d = distances(q, self.at[rows])
        keep = d <= far[:, None]
        if len(rows) > k:
            keep &= d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        of, which = np.nonzero(keep)
        order = np.lexsort((which, d[of, which], of))
        of, which = of[order], which[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        first = place < k
        of, which = of[first], which[first]
        return of, rows[which], d[of, which], place[first] + 1


def placed(axes: tuple[str, ...]) -> Column:
    return reduce(Column.__and__, [F.abs(F.col(a).cast("double")) < F.lit(float("inf")) for a in axes])


def coordinates(batch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1) if len(names) else np.zeros((batch.num_rows, 0))


class Leaves:
    """A cloud dealt to leaves: what each holds is known on the driver (a row a leaf), its points are written."""

    def __init__(self, points: DataFrame, k: int, axes: tuple[str, ...], carry: tuple[str, ...] = ()):
        self.axes, self.k = axes, k
        self.at = [f"_p{i}" for i in range(len(axes))]
        sided = points.where(placed(axes)).select(F.col("point_id").alias("pid"), *[F.col(a).cast("double").alias(c) for a, c in zip(axes, self.at, strict=True)], *[F.col(c).alias(f"p{c}") for c in carry])
        n = sided.count()
        self.depth = min(MOST_DEPTH, max(0, int(np.ceil(np.log2(max(n, 1) / LEAF)))))
        some = sided if not self.depth else sided.where(F.pmod(F.xxhash64("pid"), F.lit(max(1, n // (SAMPLE << self.depth)))) == 0)
        self.tree = Tree(some.select(self.at).toPandas().to_numpy(float), self.depth) if self.depth else Tree(np.zeros((0, len(axes))), 0)
        self.points = saved(self.dealt(sided))
        ends = [f(c).alias(f"{f.__name__}{c}") for f in (F.min, F.max) for c in self.at]
        rows = self.points.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *ends).orderBy("leaf").collect()
        self.names, self.counts = np.array([r["leaf"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
        self.low, self.high = (np.array([[r[f"{f}{c}"] for c in self.at] for r in rows], float).reshape(-1, len(axes)) for f in ("min", "max"))

    def carrying(self, columns: DataFrame) -> Leaves:
        """The same leaves with columns (pid and others) in place of those carried."""
        other = copy(self)
        other.points = self.points.select("leaf", "pid", *self.at).join(columns, "pid", "left")
        return other

    def dealt(self, sided: DataFrame) -> DataFrame:
        """The points with their leaf; of those at one place k for each portion of rows."""
        tree, at, k = self.tree, self.at, self.k
        schema = T.StructType([T.StructField("leaf", T.LongType()), *sided.schema.fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = coordinates(batch, at)
                rows = representatives(batch.column("pid"), own, k)
                leaf = tree.leaf(own[rows])
                batch = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), *batch.columns], names=schema.names)

        return sided.mapInArrow(run, schema)

    def meet(self, points: DataFrame, asked: DataFrame, answer, schema: T.StructType, columns: list[str]) -> DataFrame:
        """answer(leaf, ids and carried columns, queries) for the queries (leaf and columns) of each leaf, with its points."""
        counts = asked.groupBy("leaf").count().where(F.col("count") > ASKERS).collect()  # a row a leaf
        copies = {r["leaf"]: -(-r["count"] // ASKERS) for r in counts}
        of = F.create_map(*[F.lit(int(x)) for pair in copies.items() for x in pair])[F.col("leaf")] if copies else F.lit(None)
        number = F.coalesce(of, F.lit(1)).cast("int")
        carried = [c for c in points.columns if c not in ("leaf", *self.at)]
        nothing = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
        held = points.select("leaf", F.explode(F.sequence(F.lit(0), number - 1)).alias("copy"), F.lit(0).alias("kind"), *self.at, *carried, *nothing(asked, columns))
        asking = asked.select("leaf", F.pmod(F.xxhash64("qid"), number).cast("int").alias("copy"), F.lit(1).alias("kind"), *[F.lit(None).cast("double").alias(c) for c in self.at], *nothing(points, carried), *columns)
        # A number of its own: leaves are few bytes and much work, which Spark would put into few tasks.
        parts = max(1, min(MOST_TASKS, len(self.names) + sum(copies.values())))
        both = held.unionByName(asking).repartition(parts, "leaf", "copy").sortWithinPartitions("leaf", "copy", "kind")
        at, k = self.at, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, pending, leaf, known, queries = None, [], None, None, []

            def settled() -> None:
                """One table of the leaf's points, of those at one place k."""
                nonlocal leaf, known
                table = pa.Table.from_batches(pending).combine_chunks()
                own = coordinates(table, at)
                rows = representatives(table.column("pid").combine_chunks(), own, k)
                known, leaf = table.select(carried).take(pa.array(rows)), Leaf(own[rows])

            def answered() -> Iterator[pa.RecordBatch]:
                if queries and pending and leaf is None:
                    settled()
                if queries and leaf is not None:
                    table = pa.Table.from_batches(queries).combine_chunks()
                    yield from answer(place[0], leaf, known, table)
                queries.clear()

            for batch in batches:
                where = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "copy", "kind")], axis=1)
                cuts = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
                for start, end in zip([0, *cuts], [*cuts, len(where)], strict=True):
                    if start == end:
                        continue
                    own, kind = tuple(where[start, :2].tolist()), where[start, 2]
                    if own != place:
                        yield from answered()
                        place, pending, leaf, known = own, [], None, None
                    part = batch.slice(start, end - start)
                    if kind == 0:
                        pending.append(part.select([*at, *carried]))
                        if len(pending) > 1 and sum(x.num_rows for x in pending) > 8 * LEAF:
                            # Many rows at few places: only those that stand for them stay.
                            table = pa.Table.from_batches(pending).combine_chunks()
                            rows = representatives(table.column("pid").combine_chunks(), coordinates(table, at), k)
                            pending = table.take(pa.array(rows)).combine_chunks().to_batches()
                    else:
                        queries.append(part.select(columns))
                        if sum(x.num_rows for x in queries) >= LEAF:
                            yield from answered()
            yield from answered()

        return both.mapInArrow(run, schema)


def reaches(queries: DataFrame, leaves: Leaves, radius: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """qid, _q*, q* (the columns of keep), far (a bound on the distance of the k-th nearest point, radius at most), looks (the leaves that can hold a nearer one); written."""
    axes, k, most = leaves.axes, leaves.k, np.inf if radius is None else float(radius)
    at = [f"_q{i}" for i in range(len(axes))]
    sided = queries.where(placed(axes)).select(F.col("point_id").alias("qid"), *[F.col(a).cast("double").alias(c) for a, c in zip(axes, at, strict=True)], *[F.col(c).alias(f"q{c}") for c in keep])
    schema = T.StructType([*sided.schema.fields, T.StructField("far", T.DoubleType()), T.StructField("looks", T.ArrayType(T.LongType()))])
    shown, tree, names, counts, low, high = sided.columns, leaves.tree, leaves.names, leaves.counts, leaves.low, leaves.high

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(names):
                continue
            own = coordinates(batch, at)
            # A query in a leaf without points asks in that whose box is nearest.
            leaf = tree.leaf(own)
            astray = np.flatnonzero(~np.isin(leaf, names))
            for rows in np.array_split(astray, -(-len(astray) // 256)) if len(astray) else []:
                leaf[rows] = names[apart(own[rows], own[rows], low, high).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), *batch.columns], names=["leaf", *batch.schema.names])

    def answer(_: int, leaf: Leaf, __: pa.Table, table: pa.Table) -> Iterator[pa.RecordBatch]:
        own = coordinates(table, at)
        far, looks = np.zeros(len(own)), [None] * len(own)
        for rows in buckets(own, TOGETHER):
            q = own[rows]
            far[rows] = bound = np.minimum(leaf.bounds(q, k), most)
            open_ = np.flatnonzero(np.isinf(bound))
            if len(open_):
                # Fewer than k points in its own leaf: so many boxes lie wholly within a distance that they hold k.
                reach = np.sqrt(np.square(np.maximum(np.abs(q[open_, None] - low[None]), np.abs(high[None] - q[open_, None]))).sum(axis=2))
                order = np.argsort(reach, axis=1)
                enough = np.cumsum(counts[order], axis=1) >= k
                last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(counts) - 1)
                far[rows[open_]] = bound[open_] = np.take_along_axis(reach, np.take_along_axis(order, last[:, None], axis=1), axis=1)[:, 0] * SLACK
            near = np.flatnonzero(apart(q.min(axis=0)[None], q.max(axis=0)[None], low, high)[0] <= bound.max() * SLACK)
            inside = apart(q, q, low[near], high[near]) <= bound[:, None] * SLACK
            for row, yes in zip(rows, inside, strict=True):
                looks[row] = names[near[yes]]
        columns = [x.combine_chunks() for x in table.select(shown).columns]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(far), pa.array(looks, pa.list_(pa.int64()))], names=schema.names)

    first = saved(sided.mapInArrow(dealt, T.StructType([T.StructField("leaf", T.LongType()), *sided.schema.fields])))
    return saved(leaves.meet(leaves.points.select("leaf", "pid", *leaves.at), first, answer, schema, shown))


def gathered(asked: DataFrame, leaves: Leaves) -> DataFrame:
    """qid, q*, pid, p* (the columns that leaves carry), d and place from 1: the k nearest points of each query of reaches within its bound; ties go to the smaller id."""
    from cloudloom.operators.neighbors import capped

    k, at = leaves.k, [c for c in asked.columns if c.startswith("_q")]
    keep = [c for c in asked.columns if c not in ("far", "looks", *at)]
    carry = [c for c in leaves.points.columns if c not in ("leaf", *leaves.at)]
    looking = asked.select(*keep, *at, "far", (F.size("looks") == 1).alias("only"), F.explode("looks").alias("leaf"))
    field = {f.name: f for f in [*asked.schema.fields, *leaves.points.schema.fields]}
    schema = T.StructType([*[field[c] for c in (*keep, *carry)], T.StructField("d", T.DoubleType()), T.StructField("place", T.IntegerType()), T.StructField("only", T.BooleanType())])

    def answer(_: int, leaf: Leaf, known: pa.Table, table: pa.Table) -> Iterator[pa.RecordBatch]:
        own, far = coordinates(table, at), table.column("far").to_numpy()
        shown, alone = table.select(keep), table.column("only").combine_chunks()
        for rows in buckets(own, TOGETHER):
            of, which, d, place = leaf.lists(own[rows], far[rows], k)
            q, p = shown.take(pa.array(rows[of])), known.take(pa.array(which))
            columns = [*q.columns, *p.select(carry).columns]
            yield pa.RecordBatch.from_arrays([*[x.combine_chunks() for x in columns], pa.array(d), pa.array(place.astype(np.int32)), alone.take(pa.array(rows[of]))], names=schema.names)

    found = leaves.meet(leaves.points, looking, answer, schema, [*keep, *at, "far", "only"])
    # What a query finds in one leaf alone is in order; the others' lists meet, k rows for each leaf.
    return found.where("only").drop("only").unionByName(capped(found.where("NOT only").drop("only", "place"), k))
