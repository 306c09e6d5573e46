"""The k most similar vectors of every vector: stable projections, kd-trees, a chi-square stopping test.

Vectors are scaled to length 1, kept as half floats (an error of about 1e-4 in a cosine) and projected by Gaussian (2-stable)
matrices to M coordinates. For two vectors at distance d the squared difference of their projections over any c coordinates is d^2 times a
chi-square variable with c degrees of freedom. A kd-tree over the projections cuts each collection (run and model) of more than CELL vectors into
cells of about CELL; its upper part is built on a bounded sample, and cells that would be larger are cut further by trees that are built in the cluster,
each on a sample of its cell. Every vector is indexed in its cell, which has a finer kd-tree of its own. A smaller collection is one cell.

A query is verified first in its home leaf, then in further leaves in the order of projected distance, and stops when, for
every leaf left, a neighbour closer than the k-th found so far would have been projected there with a
chance under 1 - CONFIDENCE: box distance^2 > chi-square quantile * d_k^2. The query then goes on, with the best so far, to the cell of the next tree,
which has a projection of its own. A tree may have parted it from such a neighbour with the chance that a chi-square variable of one degree exceeds
gap^2 / d_k^2, summed over the planes of its cell; over the trees these chances multiply. The query is finished when their product is under
1 - CONFIDENCE. In the last tree a query that is not finished is also a guest in further cells, the likeliest to hold such a neighbour first, until the chance
of all cells left, times that of the trees before, is under OPEN of 1 - CONFIDENCE. So the test holds for every query; those that would visit more than WIDE of the cells
are verified exactly against their whole collection, in blocks.
Each tree is one shuffle of the vectors, so the moved bytes are linear in them.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pothi.operators import retrieval

from .common import process_state, small, written

K, M, CELL, LEAF = 5, 8, 8192, 128
#: Chance with which a neighbour in an unvisited box would have been seen; the share of misses stays below 1 - CONFIDENCE.
CONFIDENCE = 0.9
#: Rows whose projections build the upper trees on the driver, at most, over all collections; and rows of a sample that a leaf is cut from, at least.
TREE_SAMPLE, LEAF_SAMPLE = 50_000, 16
#: Trees at least; more where cells are many (see trees_for).
TREES = 3


#: Share of 1 - CONFIDENCE that guests leave open: they are the queries that trees part most.
OPEN = 0.25
#: Share of the cells beyond which a query is verified exactly instead.
WIDE = 0.5


def chi_square_quantile(df: int, p: float) -> float:
    """Wilson-Hilferty approximation; exact enough for a stopping test."""
    lo, hi = -8.0, 8.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return df * (1 - 2 / (9 * df) + lo * math.sqrt(2 / (9 * df))) ** 3


def quantiles(confidence: float) -> np.ndarray:
    return np.array([0.0] + [chi_square_quantile(c, confidence) for c in range(1, M + 1)])


def projection(dim: int, tree: int) -> np.ndarray:
    return np.random.default_rng(97 + 1000 * tree + dim).standard_normal((dim, M)).astype(np.float32)


def trees_for(depth: int, missed: float = 0.02, crossing: float = 0.1) -> int:
    """Trees after which at most `missed` of the neighbours were never in the query's cell, if each split parts a pair with chance `crossing`; guests find the rest.

    0.1 is the chance that a median split parts two vectors with cosine 0.95.
    """
    together = (1 - crossing) ** depth
    return max(TREES, math.ceil(math.log(missed) / math.log(1 - together))) if together < 1 else TREES


class Tree:
    """Median splits on the widest coordinate of a sample, down to `leaves` leaves; boxes are the half-spaces' meets.

    below: trees that cut single leaves further; their leaves are numbered from `first` on.
    """

    def __init__(self, points: np.ndarray, leaves: int, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        depth = max(0, math.ceil(math.log2(max(leaves, 1))))
        while depth and (len(points) >> depth) < LEAF_SAMPLE:
            depth -= 1
        n = 1 << depth
        self.below: dict[int, tuple[int, Tree]] = {}
        self.size = n
        self.depth, self.dim, self.value = depth, np.zeros(n, np.int32), np.zeros(n, np.float32)
        self.lo, self.hi = np.full((n, M), -np.inf, np.float32), np.full((n, M), np.inf, np.float32)
        self._grow(points, 1, 0, np.full(M, -np.inf) if lo is None else lo, np.full(M, np.inf) if hi is None else hi)

    def cut(self, leaf: int, tree: Tree) -> None:
        self.below[leaf] = (self.size, tree)
        self.size += tree.size

    def box(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        for first, tree in self.below.values():
            if first <= leaf < first + tree.size:
                return tree.box(leaf - first)
        return self.lo[leaf], self.hi[leaf]

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Boxes of all leaves, by number. That of a leaf which is cut is empty, as no point is placed there."""
        lo, hi = self.lo.copy(), self.hi.copy()
        for leaf in self.below:
            lo[leaf] = hi[leaf] = 0
        parts = [(lo, hi), *(tree.boxes() for _, tree in self.below.values())]
        return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])

    def _grow(self, points: np.ndarray, node: int, level: int, lo: np.ndarray, hi: np.ndarray) -> None:
        if level == self.depth:
            self.lo[node - (1 << level)], self.hi[node - (1 << level)] = lo, hi
            return
        d = int((np.percentile(points, 90, axis=0) - np.percentile(points, 10, axis=0)).argmax()) if len(points) else level % M
        v = float(np.median(points[:, d])) if len(points) else 0.0
        self.dim[node], self.value[node] = d, v
        left = points[:, d] < v
        up, down = hi.copy(), lo.copy()
        up[d], down[d] = v, v
        self._grow(points[left], 2 * node, level + 1, lo, up)
        self._grow(points[~left], 2 * node + 1, level + 1, down, hi)

    def place(self, y: np.ndarray) -> np.ndarray:
        node = np.ones(len(y), np.int64)
        rows = np.arange(len(y))
        for _ in range(self.depth):
            node = 2 * node + (y[rows, self.dim[node]] >= self.value[node])
        node -= 1 << self.depth
        if self.below:
            top = node.copy()
            for leaf, (first, tree) in self.below.items():
                at = np.flatnonzero(top == leaf)
                if len(at):
                    node[at] = first + tree.place(y[at])
        return node


def parted(y: np.ndarray, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Chance, at most, that a neighbour at squared distance `bound` of each point is projected out of the point's cell: sum over the planes."""
    total = np.zeros(len(y))
    with np.errstate(divide="ignore", invalid="ignore"):
        for gap in [y[:, j] - lo[j] for j in np.flatnonzero(np.isfinite(lo))] + [hi[j] - y[:, j] for j in np.flatnonzero(np.isfinite(hi))]:
            total += 0.5 * _tail(np.maximum(gap, 0) / np.sqrt(2 * np.maximum(bound, 1e-12)))
    return np.minimum(total, 1.0)


def _tail(x: np.ndarray) -> np.ndarray:
    """The complementary error function of x >= 0, to seven digits (Abramowitz and Stegun 7.1.26)."""
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)


def further(y: np.ndarray, bound: np.ndarray, home: np.ndarray, allowed: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, cell): the cells besides its home to which each point goes, the likeliest first.

    A neighbour at squared distance `bound` is projected around the point with that variance in every coordinate; cells are taken until the chance that
    it is in none of them is at most `allowed`.
    """
    sd = np.sqrt(np.maximum(bound, 1e-12))
    edges = [np.unique(np.concatenate([lo[:, j], hi[:, j]])) for j in range(lo.shape[1])]
    places = [(np.searchsorted(e, lo[:, j]), np.searchsorted(e, hi[:, j])) for j, e in enumerate(edges)]
    points, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 20) // len(lo))
    for s in range(0, len(y), step):
        at = np.arange(s, min(s + step, len(y)))
        chance = np.ones((len(at), len(lo)))
        for j, (e, (low, high)) in enumerate(zip(edges, places)):
            z = (e[None] - y[at, j, None]) / (sd[at, None] * math.sqrt(2))
            below = 0.5 * _tail(np.abs(z))
            below = np.where(z > 0, 1 - below, below)
            chance *= below[:, high] - below[:, low]
        rank = chance.copy()
        rank[np.arange(len(at)), home[at]] = 2
        order = np.argsort(-rank, axis=1, kind="stable")
        left = 1 - np.cumsum(np.take_along_axis(chance, order, 1), axis=1)
        # A cell is taken if without it too much would be left; empty ones never are.
        i, c = np.nonzero((left[:, :-1] > allowed[at, None]) & (np.take_along_axis(chance, order, 1)[:, 1:] > 0))
        points.append(at[i])
        cells.append(order[i, c + 1])
    return np.concatenate(points), np.concatenate(cells)


def _outside(y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance of each point to each box, and the number of coordinates in which it is outside."""
    dist = np.zeros((len(y), len(lo)), np.float32)
    count = np.zeros((len(y), len(lo)), np.int8)
    for j in range(y.shape[1]):
        gap = np.maximum(np.maximum(lo[:, j] - y[:, j, None], y[:, j, None] - hi[:, j]), 0)
        dist += gap * gap
        count += gap > 0
    return dist, count


def _leaves(y: np.ndarray) -> list[np.ndarray]:
    """Rows of a cell's kd-tree leaves of at most LEAF rows; equal points are cut anywhere."""
    out, todo = [], [np.arange(len(y))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        p = y[rows]
        order = np.argpartition(p[:, int(np.ptp(p, axis=0).argmax())], len(rows) // 2)
        todo += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
    return out


class Cell:
    """A cell's vectors under a kd-tree of their projections y. Those that are guests are queries only; a guest's home is the nearest leaf."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, guest: np.ndarray | None = None):
        self.ids, self.x, self.y = ids, x, y
        members = np.arange(len(ids)) if guest is None else np.flatnonzero(~guest)
        self.leaves = [members[rows] for rows in _leaves(y[members])] if len(members) else []
        self.home = np.full(len(ids), -1, np.int64)
        for i, rows in enumerate(self.leaves):
            self.home[rows] = i
        self.lo = np.array([self.y[r].min(0) for r in self.leaves]).reshape(-1, M)
        self.hi = np.array([self.y[r].max(0) for r in self.leaves]).reshape(-1, M)
        guests = np.flatnonzero(self.home < 0) if self.leaves else np.zeros(0, np.int64)
        for start in range(0, len(guests), 1024):
            at = guests[start : start + 1024]
            self.home[at] = _outside(y[at], self.lo, self.hi)[0].argmin(1)

    def search(self, queries: np.ndarray, who: np.ndarray, best: np.ndarray, k: int, chi: np.ndarray) -> None:
        """Improve the k best (ids `who`, similarities `best`, descending; -1 and -inf where none) of the rows `queries` in place."""
        if not self.leaves:
            return
        order = queries[np.argsort(self.home[queries], kind="stable")]
        for start in range(0, len(order), 256):
            q = order[start : start + 256]
            dist, crossed = _outside(self.y[q], self.lo, self.hi)
            quantile = chi[crossed]
            seen = np.zeros(len(self.leaves), bool)
            todo = np.zeros(len(self.leaves), bool)
            todo[self.home[q]] = True
            while todo.any():
                seen |= todo
                at = np.concatenate([self.leaves[i] for i in np.flatnonzero(todo)])
                s = self.x[q] @ self.x[at].T
                least = np.maximum(best[q, k - 1], -2.0)
                if least.min() == -2.0 and s.shape[1] > k + 1:  # the first leaf: of each query only its k + 1 best, itself among them
                    least = np.maximum(least, np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1] - 1e-6)
                i, j = np.nonzero(s > least[:, None])
                fresh = self.ids[q[i]] != self.ids[at[j]]
                i, j = i[fresh], j[fresh]
                if len(i):
                    self._merge(q, i, self.ids[at[j]], s[i, j], best, who, k)
                kth = best[q, k - 1]
                some = np.isfinite(kth)
                reach = np.where(some[:, None], quantile * np.where(some, 2 - 2 * kth, 0)[:, None], np.inf)  # all leaves, as long as k are not found
                todo = (dist <= reach).any(0) & ~seen

    @staticmethod
    def _merge(q: np.ndarray, i: np.ndarray, ids: np.ndarray, sims: np.ndarray, best: np.ndarray, who: np.ndarray, k: int) -> None:
        touched = np.unique(i)
        rows = np.concatenate([np.repeat(touched, k), i])
        all_ids = np.concatenate([who[q[touched]].ravel(), ids])
        all_s = np.concatenate([best[q[touched]].ravel(), sims])
        # One entry per neighbour: a later tree meets those of the earlier ones again.
        order = np.lexsort((-all_s, all_ids, rows))
        rows, all_ids, all_s = rows[order], all_ids[order], all_s[order]
        again = np.concatenate([[False], (rows[1:] == rows[:-1]) & (all_ids[1:] == all_ids[:-1]) & (all_ids[1:] >= 0)])
        rows, all_ids, all_s = rows[~again], all_ids[~again], all_s[~again]
        order = np.lexsort((all_ids, -all_s, rows))
        rows, all_ids, all_s = rows[order], all_ids[order], all_s[order]
        take = np.searchsorted(rows, touched)[:, None] + np.arange(k)
        who[q[touched]], best[q[touched]] = all_ids[take], all_s[take]


def unit_vectors(df: DataFrame, dimensions: dict[str, int]) -> DataFrame:
    """vec_id, run_id, model, v (half floats of length 1, as bytes) of the rows that are not void.

    Void: null, of another size than the model's, with a null or infinite entry, or all zero.
    """
    dims = dict(dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("vector")
            models = np.array(b.column("model").to_pylist(), dtype=object)
            sizes = np.diff(col.offsets.to_numpy())
            for m, dim in dims.items():
                rows = np.flatnonzero((models == m) & (sizes == dim) & ~np.asarray(col.is_null()))
                if not len(rows):
                    continue
                x = np.asarray(col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
                norm = np.sqrt((x * x).sum(1))
                ok = np.isfinite(norm) & (norm > 0)
                if not ok.any():
                    continue
                rows, x = rows[ok], (x[ok] / norm[ok, None]).astype(np.float16)
                data = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, x.nbytes + 1, 2 * dim, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("run_id").take(take), b.column("model").take(take), data], ["vec_id", "run_id", "model", "v"])

    base = df.where(F.col("vec_id").isNotNull() & F.col("model").isin(*dims) & F.col("vector").isNotNull())
    return base.select("vec_id", F.coalesce("run_id", F.lit("")).alias("run_id"), "model", F.col("vector").cast("array<float>").alias("vector")).mapInArrow(run, "vec_id long, run_id string, model string, v binary")


def _rows(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """Equal-sized binary values as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind).reshape(len(column), -1)


def _binary(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(len(a) + 1, dtype=np.int32) * np.int32(a.nbytes // max(len(a), 1))), pa.py_buffer(a)])


def _unpickled(shared) -> dict:
    """The value of a broadcast of pickled bytes, loaded once per worker process."""
    state, blob = process_state("vectors"), shared.value
    if state.get("of") is not blob:
        state["of"], state["value"] = blob, pickle.loads(blob)
    return state["value"]


def _boxes(shared, tree: int, g: int) -> tuple[np.ndarray, np.ndarray]:
    """The boxes of a collection's tree in a broadcast of (forest, ...), united once per worker process."""
    value, state = _unpickled(shared), process_state("vectors")
    if state.get("boxes_of") is not value:
        state["boxes_of"], state["boxes"] = value, {}
    if (tree, g) not in state["boxes"]:
        state["boxes"][tree, g] = value[0][tree][g].boxes()
    return state["boxes"][tree, g]


def _freed(table: DataFrame) -> DataFrame:
    """A written table; the shuffles behind it are deleted when the JVM finds that nothing refers to them, so it is told to look."""
    table.sparkSession._jvm.System.gc()
    return table


def dimensions_of(df: DataFrame) -> dict[str, int]:
    """Each model's size: that of most of its vectors, of several the largest."""
    sizes = df.where(F.col("model").isNotNull() & (F.size("vector") > 0)).groupBy("model", F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    return {r["model"]: r["size"] for r in sizes.groupBy("model").agg(F.max(F.struct("n", "size"))["size"].alias("size")).collect()}


_STATE = [("id", np.int64), ("s", np.float32)]
#: Rows of a query in the last tree: one row; of several the one in its own cell, and those in further cells; one row that is verified exactly.
ALONE, SPLIT, GUEST, EXACT = 0, 1, 2, 3


def forests(vectors: DataFrame, sizes: dict[int, int], dims: dict[int, int], trees: int) -> list[dict[int, Tree]]:
    """For every tree the kd-tree of each large collection. vectors: g, v; sizes and dims by g.

    The upper trees have so many leaves as a sample of TREE_SAMPLE rows over all collections allows; where cells would be larger than CELL,
    samples of the cells (LEAF_SAMPLE rows for each of their leaves) are cut in the cluster, a group a cell.
    """
    spark, total = vectors.sparkSession, sum(sizes.values())
    if not sizes:
        return [{} for _ in range(trees)]
    part = 1 << 30
    wanted = {g: math.ceil(n / CELL) for g, n in sizes.items()}
    upper = {g: max(1, min(wanted[g], TREE_SAMPLE * n // (2 * LEAF_SAMPLE * total))) for g, n in sizes.items()}
    hashed = F.pmod(F.xxhash64(F.lit(5), "v"), F.lit(part))

    def drawn(rows: dict[int, float]) -> DataFrame:
        """About so many distinct vectors of each collection: of the vector, not of the row, is the hash."""
        shares = F.broadcast(spark.createDataFrame([(g, int(min(1.0, r / sizes[g]) * part)) for g, r in rows.items()], "g long, _below long"))
        return vectors.join(shares, "g").where(hashed < F.col("_below")).select("g", "v")

    sample = drawn({g: max(2 * LEAF_SAMPLE * upper[g], 64) for g in sizes}).dropDuplicates(["g", "v"]).toPandas()
    points = {g: np.frombuffer(b"".join(p["v"]), np.float16).astype(np.float32).reshape(len(p), -1) for g, p in sample.groupby("g")}
    forest = [{g: Tree(points[g] @ projection(dims[g], i), upper[g]) if g in points else Tree(np.zeros((0, M)), 1) for g in sizes} for i in range(trees)]
    deep = {g for g in sizes if g in points and wanted[g] > 2 * upper[g]}
    if deep:
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(({g: dims[g] for g in deep}, [{g: t for g, t in f.items() if g in deep} for f in forest])))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dims, forest = _unpickled(shared)
            for b in batches:
                of = b.column("g").to_numpy()
                for g in np.unique(of):
                    rows = np.flatnonzero(of == g)
                    x = _rows(b.column("v").take(pa.array(rows)), np.float16).astype(np.float32)
                    for i, f in enumerate(forest):
                        y = (x @ projection(dims[g], i)).astype(np.float32)
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, g)), pa.array(f[g].place(y)), _binary(y)], ["tree", "g", "leaf", "y"])

        def grow(t: pa.Table) -> pa.Table:
            forest = _unpickled(shared)[1]
            i, g, leaf = (t.column(c)[0].as_py() for c in ("tree", "g", "leaf"))
            lo, hi = forest[i][g].box(leaf)
            grown = Tree(_rows(t.column("y"), np.float32), max(1, len(t) // (2 * LEAF_SAMPLE)), lo, hi)
            return pa.table({"tree": t.column("tree").slice(0, 1), "g": t.column("g").slice(0, 1), "leaf": t.column("leaf").slice(0, 1), "grown": pa.array([cloudpickle.dumps(grown)], pa.binary())})

        rows = drawn({g: 2 * LEAF_SAMPLE * wanted[g] for g in deep}).mapInArrow(spread, "tree int, g long, leaf long, y binary").groupBy("tree", "g", "leaf")
        # A node of a tree takes some 80 bytes, so N vectors make some N / 100 bytes of trees.
        for r in rows.applyInArrow(grow, "tree int, g long, leaf long, grown binary").toLocalIterator():
            grown = pickle.loads(r["grown"])
            if grown.size > 1:
                forest[r["tree"]][r["g"]].cut(r["leaf"], grown)
    return forest


def most_similar(df: DataFrame, k: int = K, dimensions: dict[str, int] | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """vec_id, neighbour, similarity, rank: the k vectors of the same run and model with the highest cosine to each vector.

    dimensions: size of each model's vectors; by default that of most of them. Repeated vec_ids count once. Equal similarity: the smaller vec_id first.
    Equal vectors under many ids: the k + 1 smallest ids are indexed, the others take the k smallest as neighbours, so a group of copies however large
    costs no pairs. A collection of fewer than k + 1 vectors gives each the rest. Void vectors take no part, nor do models outside `dimensions` where it is
    given. A null run is a run of its own. Empty input gives no row.
    """
    dimensions = dimensions or dimensions_of(df)
    spark = df.sparkSession
    chi, log_miss = quantiles(confidence), math.log(1 - confidence)
    group = F.xxhash64(F.lit(11), "run_id", "model")
    valid = unit_vectors(df, dimensions).withColumn("g", group).withColumn("_copy", F.xxhash64("v"))
    w = Window.partitionBy("g", "_copy").orderBy("vec_id")
    kept = valid.withColumn("_rank", F.dense_rank().over(w)).where(F.col("_rank") <= k + 1)
    kept = _freed(written(kept.dropDuplicates(["g", "_copy", "vec_id"]).select("g", F.xxhash64(F.lit(23), "run_id", "model").alias("whole"), "model", "_copy", "vec_id", "v")))
    # Of the collections only those of more than CELL indexed vectors reach the driver: at most one for CELL rows.
    total = kept.count()
    large = kept.groupBy("g", "model").agg(F.count("*").alias("n")).where(F.col("n") > CELL).collect()
    sizes, dims = {r["g"]: r["n"] for r in large}, {r["g"]: dimensions[r["model"]] for r in large}
    depth = max([math.ceil(math.log2(n / CELL)) for n in sizes.values()], default=0)
    trees = trees_for(depth) if sizes else 1
    forest = forests(kept.select("g", "v"), sizes, dims, trees)
    first = []  # number of each tree's first cell, by collection
    for f in forest:
        ends = np.cumsum([0, *[t.size for t in f.values()]]).tolist()
        first.append(dict(zip(f, ends)))
    index = spark.sparkContext.broadcast(cloudpickle.dumps((forest, first)))
    tasks = max(8, 2 * math.ceil(total / CELL))

    def cells(i: int, of: np.ndarray, x: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Cell of each vector in tree i; that of a small collection is the collection's own (`whole`, below zero)."""
        forest, first = _unpickled(index)
        out = whole.copy()
        for g in np.unique(of):
            if g in forest[i]:
                rows = of == g
                out[rows] = first[i][g] + forest[i][g].place(x[rows] @ projection(x.shape[1], i))
        return out

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            model = np.array(b.column("model").to_pylist(), object)
            for m in dict.fromkeys(model):
                rows = pa.array(np.flatnonzero(model == m))
                part = b.take(rows)
                x, of = _rows(part.column("v"), np.float16).astype(np.float32), part.column("g").to_numpy()
                n = len(part)
                state = np.zeros((n, k), _STATE)
                state["id"], state["s"] = -1, -np.inf
                whole = -1 - np.abs(part.column("whole").to_numpy() >> 1)
                yield pa.RecordBatch.from_arrays([pa.array(cells(0, of, x, whole)), part.column("g"), part.column("vec_id"), part.column("v"), _binary(state), pa.array(np.zeros(n, np.float32)), pa.array(np.full(n, ALONE, np.int8))], ["cell", "g", "vec_id", "v", "best", "miss", "role"])

    # miss: logarithm of the chance that a closer neighbour was parted from the query in every tree so far.
    shape = "cell long, g long, vec_id long, v binary, best binary, miss float, role byte"
    rows = kept.select("g", "whole", "model", "vec_id", "v").mapInArrow(start, shape)

    def round_(i: int):
        last = i + 1 == trees

        def visit(t: pa.Table) -> pa.Table:
            forest, first = _unpickled(index)
            g, cell = t.column("g")[0].as_py(), t.column("cell")[0].as_py()
            ids, x = t.column("vec_id").to_numpy(), _rows(t.column("v"), np.float16).astype(np.float32)
            y = x @ projection(x.shape[1], i)
            state = _rows(t.column("best"), np.uint8).copy().view(_STATE).reshape(len(ids), k)
            who, best = state["id"].copy(), state["s"].copy()
            miss, role = t.column("miss").to_numpy().astype(np.float64), t.column("role").to_numpy().copy()
            Cell(ids, x, y, role == GUEST).search(np.flatnonzero(miss > log_miss), who, best, k, chi)
            state["id"], state["s"] = who, best
            bound = np.where(np.isfinite(best[:, k - 1]), 2 - 2 * best[:, k - 1], 4.0)
            if cell < 0:
                miss[:] = -np.inf
            elif not last:
                miss = np.where(miss > log_miss, miss + np.log(np.maximum(parted(y, *forest[i][g].box(cell - first[i][g]), bound), 1e-30)), miss)
            of = np.full(len(ids), g)
            at = ids if last else np.full(len(ids), cell) if cell < 0 else cells(i + 1, of, x, ids)
            v, also = pa.nulls(len(ids), pa.binary()) if last else t.column("v").combine_chunks(), np.zeros(0, np.int64)
            if i + 2 == trees and cell >= 0:
                open_ = np.flatnonzero(miss > log_miss)
                n, c = further(x[open_] @ projection(x.shape[1], i + 1), bound[open_], at[open_] - first[i + 1][g], OPEN * np.exp(log_miss - miss[open_]), *_boxes(index, i + 1, g))
                wide = np.bincount(n, minlength=len(open_)) > WIDE * forest[i + 1][g].size
                role[open_[n]] = SPLIT
                role[open_[wide]], miss[open_[wide]] = EXACT, -np.inf
                n, c = n[~wide[n]], c[~wide[n]]
                also = open_[n]
                at, role = np.concatenate([at, first[i + 1][g] + c]), np.concatenate([role, np.full(len(also), GUEST, np.int8)])
            take = np.concatenate([np.arange(len(ids)), also])
            state = state[take]
            # A guest brings its k-th similarity, not its neighbours: what is closer is merged after the last tree.
            guests = state[len(ids) :]
            guests["id"], guests["s"] = -1, guests["s"][:, -1:]
            return pa.table({"cell": pa.array(at), "g": pa.array(of[take]), "vec_id": pa.array(ids[take]), "v": v.take(pa.array(take)) if len(also) else v, "best": _binary(state), "miss": pa.array(miss[take].astype(np.float32)), "role": pa.array(role)})

        return visit

    for i in range(trees):
        rows = rows.repartition(tasks, "cell", "g").groupBy("cell", "g").applyInArrow(round_(i), shape)
        if i % 3 == 2 and i + 1 < trees:  # the shuffles of three trees at a time are on disk, however many trees there are
            rows = _freed(written(rows))
    if sizes:
        rows = written(rows.select("vec_id", "best", "role"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            state = _rows(b.column("best"), np.uint8).copy().view(_STATE).reshape(len(b), k)
            r, c = np.nonzero(state["id"] >= 0)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(r)), pa.array(state["id"][r, c]), pa.array(state["s"][r, c].astype(np.float64)), pa.array((c + 1).astype(np.int32))], ["vec_id", "neighbour", "similarity", "rank"])

    found = "vec_id long, neighbour long, similarity double, rank int"
    out = (rows.where(F.col("role") == ALONE) if sizes else rows).select("vec_id", "best").mapInArrow(unpack, found)
    if sizes:
        several = rows.where(F.col("role").isin(SPLIT, GUEST)).select("vec_id", "best").mapInArrow(unpack, found).groupBy("vec_id", "neighbour").agg(F.max("similarity").alias("similarity"))
        order = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour")
        out = out.unionByName(several.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        left = rows.where(F.col("role") == EXACT).select("vec_id")
        if left.limit(1).count():
            whole = df.where(F.col("model").isin(*dimensions)).select("vec_id", F.coalesce("run_id", F.lit("")).alias("run_id"), "model", "vector")
            asked = whole.join(small(left), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "run_id", "model", F.col("vector").alias("query"))
            asked = asked.where(F.element_at(F.create_map(*[F.lit(x) for m, d in dimensions.items() for x in (m, d)]), F.col("model")) == F.size("query"))
            exact = retrieval.dense(whole, asked, k)
            out = out.unionByName(exact.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("neighbour"), F.col("score").alias("similarity"), "rank"))
    copies = kept.groupBy("g", "_copy").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).where(F.size("ids") == k + 1)
    rest = valid.select("g", "_copy", "vec_id").join(small(copies), ["g", "_copy"]).where(F.col("vec_id") > F.col("ids")[k])
    more = rest.select("vec_id", F.posexplode(F.slice("ids", 1, k)).alias("i", "neighbour")).select("vec_id", "neighbour", F.lit(1.0).alias("similarity"), (F.col("i") + 1).alias("rank")).distinct()
    return out.unionByName(more)


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b, of which at least one has the other among its neighbours; each pair once."""
    return neighbours.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).where(F.col("vec_a") < F.col("vec_b")).distinct()
