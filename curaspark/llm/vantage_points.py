"""Approximate nearest neighbours: a vantage-point tree per shard, with relaxed triangle-inequality pruning.

Nearness is the largest inner product. Rows become points of a metric space by one more component: with M the largest norm
of a tree, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0), |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest points have the
largest inner products. A node keeps a vantage point and, for either half of its rows, the least and largest distance from
it; the triangle inequality gives a lower bound for every leaf. A leaf is left out where factor * bound exceeds the distance
of the k-th best found: factor 1 is exact, larger factors leave out more.

The index is a table of node and leaf rows. A search deals its shards and the queries, in parts, to cells (shard, part); a
task reads the tree of its cell, then streams the queries past it, so its memory is one tree and one block of queries.

Edges: rows whose id is null, or whose vector is null, empty, zero or has null or non-finite components, take no part. Vectors
of another length than the query's have no inner product with it and are no candidates. Of rows with one id the smallest
vector (compared as arrays) counts; equal vectors are one point with all their ids. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.llm.storage import drop, materialize, new_path

#: Distinct vectors of a leaf; queries handled at once; pairs whose inner products are summed at once.
LEAF, BLOCK, PAIRS = 64, 512, 1 << 14
#: Bytes of a shard's vectors as doubles: a 24th of all, within these bounds. Bytes of a part of the queries.
SHARD_BYTES, PART_BYTES = (4 << 20, 32 << 20), 32 << 20
#: A factor that is not given is tuned in each cell: the largest that keeps this share of the neighbours of its first queries.
KEPT, TUNE_ROWS, MAX_FACTOR = 0.98, 64, 64.0
#: Rounding of bounds and distances, in parts of the norms.
SLACK = 1e-6

INDEX = "shard int, kind int, dim int, number int, vec array<double>, ids array<long>, sizes array<int>, bounds array<double>"
NODE, LEAVES, QUERY = 0, 1, 2


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and n+1 offsets of a list column; a null list is empty."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last: equal vectors have equal results wherever they lie."""
    out = np.empty(len(a))
    for lo in range(0, len(a), PAIRS):
        product = (a[lo : lo + PAIRS] * b[lo : lo + PAIRS]).T
        total = np.zeros(product.shape[1])
        for row in product:
            total += row
        out[lo : lo + PAIRS] = total
    return out


class Tree:
    """A balanced vantage-point tree in heap order: node j has the children 2j + 1 and 2j + 2; leaves are segments of the rows."""

    def __init__(self, points: np.ndarray, groups: list[np.ndarray], vantages: np.ndarray, bounds: np.ndarray, edges: np.ndarray, top: float):
        self.points, self.groups, self.vantages, self.bounds, self.edges, self.top = points, groups, vantages, bounds, edges, top
        self.sizes = np.array([len(g) for g in groups], np.int64)

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray) -> Tree:
        view = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
        _, first, group = np.unique(view, return_index=True, return_inverse=True)
        order = np.lexsort((ids, group))
        groups = np.split(ids[order], np.cumsum(np.bincount(group))[:-1])
        points = x[first]
        norms = (points * points).sum(1)
        top = float(norms.max())
        lifted = np.concatenate([points, np.sqrt(np.maximum(top - norms, 0))[:, None]], 1)
        perm, segments = np.arange(len(points)), [(0, len(points))]
        vantages, bounds = [], []
        while len(points) > LEAF * len(segments):
            below = []
            for lo, hi in segments:
                own = perm[lo:hi]
                away = ((lifted[own] - lifted[own[0]]) ** 2).sum(1)
                at = own[int(away.argmax())]
                d = np.sqrt(((lifted[own] - lifted[at]) ** 2).sum(1))
                near = np.argsort(d, kind="stable")
                perm[lo:hi], d, mid = own[near], d[near], (hi - lo + 1) // 2
                vantages.append(points[at])
                bounds.append([d[0], d[mid - 1], d[mid], d[-1]])
                below += [(lo, lo + mid), (lo + mid, hi)]
            segments = below
        edges = np.array([lo for lo, _ in segments] + [len(points)])
        return cls(points[perm], [groups[i] for i in perm], np.array(vantages).reshape(-1, x.shape[1]), np.array(bounds).reshape(-1, 4), edges, top)

    def leaf_bounds(self, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """(queries, leaves): no point of the leaf is nearer to the query."""
        lower = np.zeros((len(q), 1))
        if len(self.vantages):
            away = np.sqrt(np.maximum(norms[:, None] + self.top - 2 * (q @ self.vantages.T), 0))
        at = 0
        while at < len(self.vantages):
            n = lower.shape[1]
            d, b = away[:, at : at + n], self.bounds[at : at + n]
            halves = [np.maximum(lower, np.maximum(b[:, i] - d, d - b[:, i + 1])) for i in (0, 2)]
            lower, at = np.stack(halves, 2).reshape(len(q), 2 * n), at + n
        slack = SLACK * (np.sqrt(norms) + math.sqrt(self.top))
        return np.maximum(lower - slack[:, None], 0)

    def search(self, own: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score, bound of the leaf it lay in) of the k best of every query that leaves let through."""
        norms = (q * q).sum(1)
        bounds = self.leaf_bounds(q, norms)
        found = _Best(len(q), k)
        margin = SLACK * np.sqrt(norms * self.top) * 1e-6
        seen = np.zeros(bounds.shape, bool)

        def visit(leaf: int, rows: np.ndarray) -> None:
            lo, hi = self.edges[leaf], self.edges[leaf + 1]
            rough = q[rows] @ self.points[lo:hi].T
            r, c = np.nonzero(~(rough < (found.least[rows] - margin[rows])[:, None]))
            if not len(r):
                return
            r, c = rows[r], c + lo
            score = inner_products(q[r], self.points[c])
            times = np.minimum(self.sizes[c], k + 1)
            ids = np.concatenate([g[: k + 1] for g in self.groups[lo:hi]])
            starts = np.cumsum(np.minimum(self.sizes[lo:hi], k + 1)) - np.minimum(self.sizes[lo:hi], k + 1)
            spread = np.repeat(np.arange(len(c)), times)
            place = np.arange(len(spread)) - np.repeat(np.cumsum(times) - times, times)
            vec = ids[starts[c[spread] - lo] + place]
            other = vec != own[r[spread]]
            spread, vec = spread[other], vec[other]
            found.add(r[spread], vec, score[spread], bounds[r[spread], leaf])

        def reach(rows: np.ndarray | slice, leaf: int | np.ndarray) -> np.ndarray:
            return ~(factor * bounds[rows, leaf] > np.sqrt(np.maximum(norms[rows] + self.top - 2 * found.least[rows], 0)))

        nearest = bounds.argmin(1)
        for leaf in np.unique(nearest):
            rows = np.flatnonzero(nearest == leaf)
            seen[rows, leaf] = True
            visit(int(leaf), rows)
        for leaf in np.argsort(bounds.mean(0), kind="stable").tolist():
            rows = np.flatnonzero(~seen[:, leaf] & reach(slice(None), leaf))
            if len(rows):
                visit(leaf, rows)
        return found.rows()

    def tuned(self, own: np.ndarray, q: np.ndarray, k: int, kept: float = KEPT) -> float:
        """The largest factor that still reaches this share of the true neighbours of these queries."""
        row, _, score, bound = self.search(own, q, k, 1.0)
        if not len(row):
            return 1.0
        norms = (q * q).sum(1)
        last = np.full(len(q), np.inf)
        np.minimum.at(last, row, score)
        reach = np.sqrt(np.maximum(norms + self.top - 2 * last, 0))[row]
        need = np.sort(np.where(bound > 0, reach / np.where(bound > 0, bound, 1), MAX_FACTOR))
        return float(np.clip(need[int((1 - kept) * len(need))], 1.0, MAX_FACTOR))


class _Best:
    """The k best of every query so far, best first, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.least = np.full(n, -np.inf)
        self.row = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.bound = np.zeros(0)

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray, bound: np.ndarray) -> None:
        if not len(row):
            return
        touched = np.zeros(len(self.least), bool)
        touched[row] = True
        old = touched[self.row]
        row, ids = np.concatenate([row, self.row[old]]), np.concatenate([ids, self.id[old]])
        score, bound = np.concatenate([score, self.score[old]]), np.concatenate([bound, self.bound[old]])
        order = np.lexsort((ids, -score, row))
        row, ids, score, bound = row[order], ids[order], score[order], bound[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        top = place < self.k
        last = place == self.k - 1
        self.least[row[last]] = score[last]
        kept = ~old
        self.row, self.id = np.concatenate([self.row[kept], row[top]]), np.concatenate([self.id[kept], ids[top]])
        self.score, self.bound = np.concatenate([self.score[kept], score[top]]), np.concatenate([self.bound[kept], bound[top]])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.row, self.id, self.score, self.bound


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec: array of doubles) of the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    finite: Column = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists(F.col("vec"), lambda v: v != 0))


def _unique(ids: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """One row an id: that with the smallest vector."""
    if len(np.unique(ids)) == len(ids):
        return ids, rows
    best: dict[int, np.ndarray] = {}
    for i, v in zip(ids.tolist(), rows, strict=True):
        if i not in best or v.tolist() < best[i].tolist():
            best[i] = v
    return np.array(list(best), np.int64), list(best.values())


def _index_rows(shard: int, ids: np.ndarray, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    ids, rows = _unique(ids, rows)
    dims = np.array([len(v) for v in rows])
    schema = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("dim", pa.int32()), ("number", pa.int32()), ("vec", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("bounds", pa.list_(pa.float64()))])
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        tree = Tree.build(ids[at], np.array([rows[i] for i in at]))
        out = [{"shard": shard, "kind": NODE, "dim": int(dim), "number": j, "vec": v, "ids": None, "sizes": None, "bounds": b} for j, (v, b) in enumerate(zip(tree.vantages, tree.bounds, strict=True))]
        for j, (lo, hi) in enumerate(zip(tree.edges[:-1], tree.edges[1:], strict=True)):
            out.append({"shard": shard, "kind": LEAVES, "dim": int(dim), "number": j, "vec": tree.points[lo:hi].ravel(), "ids": np.concatenate(tree.groups[lo:hi]), "sizes": tree.sizes[lo:hi], "bounds": [tree.top]})
        for lo in range(0, len(out), 256):
            yield pa.RecordBatch.from_pylist(out[lo : lo + 256], schema)


def build_index(vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Writes the index of all usable rows to path and returns it: shards by a hash of the id, a tree per shard and length."""
    rows = usable(vectors, id_col, vec_col)
    size = rows.agg(F.coalesce(F.sum(F.size("vec").cast("long") * 8), F.lit(0)).alias("b")).first()["b"]
    shards = max(1, math.ceil(size / min(max(size // 24, SHARD_BYTES[0]), SHARD_BYTES[1])))

    def run(batches):
        shard, ids, vecs = 0, [], []
        for batch in batches:
            values, off = _lists(batch.column(2))
            for i, s, lo, hi in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), off[:-1], off[1:], strict=True):
                shard = s
                ids.append(i)
                vecs.append(values[lo:hi])
        if ids:
            yield from _index_rows(shard, np.array(ids, np.int64), vecs)

    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "vec").repartitionById(shards, F.col("shard"))
    return materialize(dealt.mapInArrow(run, INDEX), "vantage-points", path)


def _tree(rows: dict[int, list]) -> Tree:
    """A tree from its node rows (number, vec, bounds) and leaf rows (number, vec, ids, sizes, bounds)."""
    nodes, leaves = sorted(rows[NODE], key=lambda r: r[0]), sorted(rows[LEAVES], key=lambda r: r[0])
    dim = len(leaves[0][1]) // len(leaves[0][3])
    points = np.concatenate([r[1] for r in leaves]).reshape(-1, dim)
    sizes = np.concatenate([r[3] for r in leaves]).astype(np.int64)
    groups = np.split(np.concatenate([r[2] for r in leaves]), np.cumsum(sizes)[:-1])
    edges = np.concatenate([[0], np.cumsum([len(r[3]) for r in leaves])])
    vantages = np.array([r[1] for r in nodes]).reshape(-1, dim)
    return Tree(points, groups, vantages, np.array([r[4] for r in nodes]).reshape(-1, 4), edges, float(leaves[0][4][0]))


def _searcher(k: int, factor: float | None):
    def run(batches):
        parts: dict[int, dict[int, list]] = {}
        trees: dict[int, Tree] = {}
        factors: dict[int, float] = {}
        for batch in batches:
            kind, dim, number = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("kind", "dim", "number"))
            vec, vec_off = _lists(batch.column("vec"))
            ids, ids_off = _lists(batch.column("ids"))
            sizes, sizes_off = _lists(batch.column("sizes"))
            bounds, bounds_off = _lists(batch.column("bounds"))
            for i in np.flatnonzero(kind != QUERY).tolist():
                cut = lambda v, off, i=i: v[off[i] : off[i + 1]]
                parts.setdefault(int(dim[i]), {NODE: [], LEAVES: []})[int(kind[i])].append((int(number[i]), cut(vec, vec_off), cut(ids, ids_off), cut(sizes, sizes_off), cut(bounds, bounds_off)))
            asked = np.flatnonzero(kind == QUERY)
            if len(asked) and parts:
                trees |= {d: _tree(rows) for d, rows in parts.items()}
                parts = {}
            for d in np.unique(dim[asked]).tolist():
                if d not in trees:
                    continue
                rows = asked[dim[asked] == d]
                q = vec[(vec_off[rows][:, None] + np.arange(d)).ravel()].reshape(-1, d)
                own = ids[ids_off[rows]]
                if d not in factors:
                    factors[d] = factor or trees[d].tuned(own[:TUNE_ROWS], q[:TUNE_ROWS], k)
                for lo in range(0, len(rows), BLOCK):
                    mine = own[lo : lo + BLOCK]
                    row, found, score, _ = trees[d].search(mine, q[lo : lo + BLOCK], k, factors[d])
                    yield pa.RecordBatch.from_arrays([pa.array(mine[row]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 20, factor: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (id, vec), its own id left out.

    factor: 1 is exact; a larger one leaves out more; None tunes it in each cell on the cell's first TUNE_ROWS queries.
    """
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    size = queries.agg(F.coalesce(F.sum(F.size("vec").cast("long") * 8), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, math.ceil(size / PART_BYTES))
    kept = [f.name for f in index.schema.fields if f.name != "shard"]
    part, shard = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)), F.col("shard")
    trees = index.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: (p * shards + shard).cast("int"))).alias("cell"), *kept)
    asked = queries.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (part * shards + s).cast("int"))).alias("cell"),
        F.lit(QUERY).alias("kind"), F.size("vec").alias("dim"), F.lit(0).alias("number"), "vec", F.array("id").alias("ids"), F.lit(None).cast("array<int>").alias("sizes"), F.lit(None).cast("array<double>").alias("bounds"),
    )
    cells = trees.unionByName(asked).repartitionById(shards * parts, F.col("cell")).sortWithinPartitions("kind", "ids")
    near = cells.mapInArrow(_searcher(k, factor), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, factor: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of each row whose id is divisible by `every`, among all other rows."""
    spark = vectors.sparkSession
    path = new_path(spark, "vantage-points")
    index = build_index(vectors, path, id_col, vec_col)
    queries = usable(vectors, id_col, vec_col).where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    out = materialize(search(index, queries, k, factor), "neighbours")
    drop(spark, path)
    return out
