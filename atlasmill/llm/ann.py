"""Approximate nearest neighbours by cosine: stable projections in kd-trees, with a chi-square stopping test.

Vectors are scaled to length 1, so the order by cosine is the order by distance. Each is projected on a few
Gaussian directions: over the true distance, a projected distance follows a chi distribution. A query takes its
projected neighbours one after another, nearest first, from a kd-tree over the projections, and verifies
each on the original vectors. It stops when a vector as near as the k-th found would have shown up by now with
the wished probability.

The same test prunes between tasks. A coarse kd-tree, grown on a bounded sample of projected rows, deals all rows
into cells. A query first searches the cell it lies in; the k-th distance found there says which other cells
can still hold a neighbour, and only these are asked. A cell with many rows is split into blocks by a
hash, so no task holds more than a block of rows or of queries, however hot a cell.

Rows with a null, zero, or non-finite vector take no part, neither do null ids; vectors of another length than the
query's are no candidates. Ties go to the smaller id; repeated rows are rows. Very long vectors are read
whole; an empty table gives an empty result; columns other than id and vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atlasmill.llm.common import stash

PROJECTIONS = 16
LEAF = 64
SURE = 0.95
SEED = 20240229
ROWS_A_BLOCK = 16_384
QUERIES_A_BLOCK = 4_096
#: The coarse tree has so many cells at most, and is grown on so many rows at most.
CELLS = 1024
SAMPLE = 32_768


def chi_square_quantile(p: float, degrees: int) -> float:
    """By bisection on the closed form for an even number of degrees."""
    half = degrees // 2

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))

    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(dim: int, projections: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, projections))


class Tree:
    """A kd-tree over projected points: median splits on the widest axis down to small leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order, low, high, cuts = np.arange(len(points)), [], [], [0]
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            own = points[self.order[a:b]]
            if b - a <= leaf:
                low.append(own.min(0))
                high.append(own.max(0))
                cuts.append(b)
                continue
            axis, mid = int(np.ptp(own, axis=0).argmax()), (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
            todo += [(a + mid, b), (a, a + mid)]  # the left half comes first, so leaves lie in order
        self.low, self.high, self.cuts = np.array(low), np.array(high), np.array(cuts)
        self.points = points[self.order]

    def leaves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by the squared distance of their boxes to q."""
        off = np.maximum(0, np.maximum(self.low - q, q - self.high))
        d = np.einsum("ij,ij->i", off, off)
        by = np.argsort(d, kind="stable")
        return by, d[by]

    def neighbours(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All points in batches by growing squared distance to q: nothing in a later batch is nearer."""
        by, near = self.leaves(q)
        places, far = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 2
        while at < len(by) or len(places):
            if at < len(by):
                fresh = np.concatenate([np.arange(self.cuts[x], self.cuts[x + 1]) for x in by[at : at + step]])
                off = self.points[fresh] - q
                places, far = np.concatenate([places, fresh]), np.concatenate([far, np.einsum("ij,ij->i", off, off)])
                at, step = at + step, step * 2
            ready = far <= near[at] if at < len(by) else np.ones(len(far), bool)
            order = np.argsort(far[ready], kind="stable")
            yield places[ready][order], far[ready][order]
            places, far = places[~ready], far[~ready]


class Cells:
    """The coarse kd-tree: splits, and a box for each cell, which reach outward without end."""

    def __init__(self, points: np.ndarray, cells: int):
        self.splits: list[tuple[int, float, int, int]] = []  # axis, value, and what lies below and above: a split or ~cell
        self.low, self.high = [], []
        dim = points.shape[1] if len(points) else 1
        self.root = self._grow(points, max(1, cells), np.full(dim, -np.inf), np.full(dim, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        axis = int(np.ptp(points, axis=0).argmax()) if len(points) > 1 else 0
        value = float(np.median(points[:, axis])) if len(points) > 1 else 0.0
        under = points[:, axis] < value if len(points) > 1 else np.zeros(0, bool)
        if cells < 2 or not under.any():
            self.low.append(low)
            self.high.append(high)
            return ~(len(self.low) - 1)
        at = len(self.splits)
        self.splits.append((axis, value, 0, 0))
        cap, floor = high.copy(), low.copy()
        cap[axis] = floor[axis] = value
        self.splits[at] = (axis, value, self._grow(points[under], cells // 2, low, cap), self._grow(points[~under], cells - cells // 2, floor, high))
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), self.root)
        while (open_ := np.flatnonzero(node >= 0)).size:
            for s in np.unique(node[open_]):
                axis, value, below, above = self.splits[s]
                own = open_[node[open_] == s]
                node[own] = np.where(points[own, axis] < value, below, above)
        return ~node

    def near(self, q: np.ndarray, reach: float) -> np.ndarray:
        """Cells whose box lies within the squared distance reach of q."""
        off = np.maximum(0, np.maximum(self.low - q, q - self.high))
        return np.flatnonzero(np.einsum("ij,ij->i", off, off) <= reach)


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((vectors * vectors).sum(1))
    return vectors / norms[:, None], norms


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, sure: float = SURE, projections: int = PROJECTIONS, known: np.ndarray | None = None) -> tuple[list[tuple[int, int, float]], int]:
    """The k nearest of vectors to each query, as (query id, id, cosine), and how many vectors were verified.

    known: a cosine that k vectors elsewhere are known to reach.
    """
    out: list[tuple[int, int, float]] = []
    visited = 0
    if not len(ids) or not len(query_ids):
        return out, visited
    across = directions(vectors.shape[1], projections)
    (unit, norms), (qunit, qnorms) = _unit(vectors), _unit(queries)
    tree = Tree(unit @ across)
    unit, ids, raw, norms = unit[tree.order], ids[tree.order], vectors[tree.order], norms[tree.order]
    shadow, bound = qunit @ across, chi_square_quantile(sure, projections)
    for i, me in enumerate(query_ids):
        rows, found, kth = [], [], -np.inf if known is None else known[i]
        for places, far in tree.neighbours(shadow[i]):
            done = False
            at, step = 0, 32
            while at < len(places) and not done:
                take = places[at : at + step]
                # A vector at distance d from the query lies within d * sqrt(bound) of it here, surely enough.
                if kth > -np.inf:
                    reach = np.searchsorted(far[at : at + step], bound * max(0.0, 2 - 2 * kth), "right")
                    done = reach < len(take)
                    take = take[:reach]
                at += step
                step = min(step * 2, 4096)
                if not len(take):
                    continue
                cos = unit[take] @ qunit[i]
                visited += len(take)
                own = ids[take] != me
                rows.append(take[own])
                found.append(cos[own])
                best = np.sort(np.concatenate(found))[::-1][:k] if len(found) else []
                if len(best) >= k:
                    kth = max(kth, best[-1])
                    keep = np.concatenate(found) >= best[-1] - 1e-9
                    rows, found = [np.concatenate(rows)[keep]], [np.concatenate(found)[keep]]
            if done:
                break
        if not rows:
            continue
        take, seen = np.concatenate(rows), np.concatenate(found)
        # Summed row by row, so that equal vectors have equal scores.
        exact = (raw[take] * queries[i]).sum(1) / (norms[take] * qnorms[i])
        best = np.lexsort((ids[take], -exact))[:k]
        out += [(int(me), int(ids[take[j]]), float(exact[j])) for j in best]
    return out, visited


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _dealt(rows: DataFrame, dim: int, trees: Cells, projections: int) -> DataFrame:
    """Adds cell, the one a row lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across = directions(dim, projections)
        for b in batches:
            cell = trees.of(_unit(_matrix(b.column("v")))[0] @ across) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell, pa.int32())], names=["id", "v", "cell"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, cell int")


def _per_cell(rows: DataFrame) -> dict[int, int]:
    """Rows of each cell; there are CELLS cells at most."""
    return {r.cell: r.n for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}


def _pieces(sizes: dict[int, int], most: int) -> Column:
    """Into how many pieces a cell is cut so that none holds more than about `most`."""
    cut = [F.lit(x) for c, n in sizes.items() for x in (c, -(-n // most))]
    return F.coalesce(F.element_at(F.create_map(*cut), F.col("cell")), F.lit(1)) if cut else F.lit(1)


def _of_length(rows: DataFrame, asked: DataFrame, dim: int, k: int, sure: float, projections: int) -> DataFrame:
    """query_id, vec_id, score, visited for vectors of one length."""
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    n = rows.count()
    wanted = min(CELLS, max(1, -(-n // ROWS_A_BLOCK) * 2 if n > ROWS_A_BLOCK else 1))
    chosen = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(1_000_000 * 0.9 * SAMPLE / n))
    sample = np.array([r.v for r in chosen.select("v").limit(SAMPLE).collect()], float).reshape(-1, dim) if wanted > 1 else np.zeros((0, dim))
    trees = Cells(_unit(sample)[0] @ directions(dim, projections) if len(sample) else np.zeros((0, projections)), wanted)
    held = stash(_dealt(rows, dim, trees, projections), "ann-rows")
    sizes = _per_cell(held)
    left = held.withColumn("block", F.pmod(F.xxhash64("id"), _pieces(sizes, ROWS_A_BLOCK)).cast("int"))
    bound = chi_square_quantile(sure, projections)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        got, visited = [], 0
        ids, vectors = a.column("id").to_numpy(), _matrix(a.column("v"))
        for at in range(0, len(b), QUERIES_A_BLOCK):
            part = b.slice(at, QUERIES_A_BLOCK)
            known = part.column("kth").to_numpy(zero_copy_only=False).astype(float)
            more, seen = search_block(ids, vectors, part.column("id").to_numpy(), _matrix(part.column("v")), k, sure, projections, np.where(np.isnan(known), -np.inf, known))
            got += more
            visited += seen
        q, i, s = zip(*got, strict=True) if got else ((), (), ())
        share = visited / len(b) / max(1, len(ids)) if len(b) else 0.0
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64()), "visited": pa.array([share] * len(q), pa.float64())})

    def met(queries: DataFrame) -> DataFrame:
        """queries: id, v, cell, kth. Blocks of a cell's rows meet slices of the queries that ask there."""
        asking = _per_cell(queries)
        slices = _pieces(asking, 4 * QUERIES_A_BLOCK)
        each = queries.withColumn("block", F.explode(F.sequence(F.lit(0), (_pieces(sizes, ROWS_A_BLOCK) - 1).cast("int"))))
        each = each.withColumn("slice", F.pmod(F.xxhash64("id", F.lit(1)), slices).cast("int"))
        own = left.where(F.col("cell").isin(list(asking))).withColumn("slice", F.explode(F.sequence(F.lit(0), (slices - 1).cast("int"))))
        at = ["cell", "block", "slice"]
        return own.groupBy(*at).cogroup(each.groupBy(*at)).applyInArrow(run, "query_id long, vec_id long, score double, visited double")

    home = stash(_dealt(asked, dim, trees, projections), "ann-queries")
    first = stash(met(home.where(F.col("cell").isin(list(sizes))).withColumn("kth", F.lit(None).cast("double"))), "ann-first")
    if len(sizes) < 2:
        return first
    kth = _best(first, k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("found"))
    there = home.join(kth, home.id == kth.query_id, "left").select("id", "v", "cell", F.when(F.col("found") >= k, F.col("kth")).alias("kth"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across, full = directions(dim, projections), np.array(sorted(sizes))
        for b in batches:
            shadow = _unit(_matrix(b.column("v")))[0] @ across if b.num_rows else np.zeros((0, projections))
            cells = []
            for q, own, c in zip(shadow, b.column("cell").to_pylist(), b.column("kth").to_pylist(), strict=True):
                near = trees.near(q, np.inf if c is None else bound * max(0.0, 2 - 2 * c))
                cells.append(np.intersect1d(near[near != own], full).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("kth"), pa.array(cells, pa.list_(pa.int32()))], names=["id", "v", "kth", "cells"])

    asking = there.mapInArrow(others, "id long, v array<double>, kth double, cells array<int>").select("id", "v", F.explode("cells").alias("cell"), "kth")
    return first.union(met(stash(asking, "ann-asking")))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", sure: float = SURE, projections: int = PROJECTIONS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `vectors` for each row of `queries`."""
    if projections % 2:
        raise ValueError("an even number of projections is needed")
    fit = F.col("v").isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    of = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(fit)
    rows, asked = of(vectors), of(queries)
    lengths = sorted(r.n for r in asked.select(F.size("v").alias("n")).distinct().collect())
    found = None
    for dim in lengths:
        part = _of_length(rows, asked, dim, k, sure, projections)
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, table.where(F.col("vec_id") % 50 == 0))
