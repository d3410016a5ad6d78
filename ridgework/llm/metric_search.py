"""Exact top-k search by inner product in an M-tree, best first.

The tree's upper level lies over the cluster: each vector goes to the cell of its nearest pivot (pivots are a bounded sample of the
vectors), and a cell keeps its pivot, covering radius and largest norm.  A large cell is cut into shards by a hash of the id; a shard
is an M-tree of its own: pages of routing entries (pivot, covering radius, distance to the parent's pivot, largest norm, smallest id) above
leaf pages of vectors with their distances to the leaf's pivot.  For a query q and a vector v,
2 q.v = |q|^2 + |v|^2 - d(q, v)^2, and the triangle inequality bounds d(q, v) from below by stored distances, first by
those to the parent, which cost no computation.  Pages are visited by descending bound until none can
change the result.  A query visits its most promising cell first; its k-th score there then rules out all cells, and within the others all
pages, whose bound is below it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, mapped, materialize, partitions, table

#: Vectors of a shard, about; vectors of a leaf page; routing entries of a page; cells of the upper level at most.
SHARD, LEAF, FANOUT, CELLS = 4096, 512, 16, 1024
K, EVERY = 5, 50
LONG = 2**63 - 1


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of doubles: exact in doubles if every inner product stays below 2 ** 53, else Python integers."""
    f = np.floor(256.0 * x)
    if f.size and np.abs(f).max() ** 2 * f.shape[1] >= 2.0**52:
        return np.array([[int(v) for v in row] for row in f.tolist()], object).reshape(f.shape)
    return f


class Page:
    """Entries of one page.  A leaf has vectors, an inner page has child pages; both have what bounds need."""

    __slots__ = ("children", "ids", "least", "norms", "parent", "points", "radii", "vectors")

    def __init__(self, points, parent, radii, norms, least, children=None, vectors=None, ids=None):
        self.points, self.parent, self.radii, self.norms, self.least = points, parent, radii, norms, least
        self.children, self.vectors, self.ids = children, vectors, ids


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - p) ** 2).sum(axis=1))


class MTree:
    """Over vectors (rows of ``x``, as from ``scaled``) with their ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        self.x, self.leaf, self.fanout, self.computed = x, leaf, fanout, 0
        self.points = x.astype(np.float64)
        self.norms = (self.points**2).sum(axis=1)
        self.ids = ids
        self.root = self._build(np.arange(len(ids)), self.points.mean(axis=0)) if len(ids) else None
        self.center = self.points.mean(axis=0) if len(ids) else None

    def exact(self) -> None:
        """From now on score in Python's integers."""
        if self.x.dtype != object:
            self.x = np.array([[int(v) for v in row] for row in self.x.tolist()], object).reshape(self.x.shape)
            pages = [self.root]
            while pages:
                page = pages.pop()
                pages += page.children or []
                if page.children is None:
                    page.vectors = np.array([[int(v) for v in row] for row in page.vectors.tolist()], object).reshape(page.vectors.shape)

    def _build(self, rows: np.ndarray, pivot: np.ndarray) -> Page:
        if len(rows) <= self.leaf:
            rows = rows[np.argsort(self.ids[rows], kind="stable")]
            p = self.points[rows]
            return Page(p, _distances(p, pivot), np.zeros(len(rows)), self.norms[rows], self.ids[rows], vectors=self.x[rows], ids=self.ids[rows])
        p = self.points[rows]
        far = _distances(p, pivot)
        chosen, gap = [int(far.argmax())], _distances(p, p[int(far.argmax())])
        owner = np.zeros(len(rows), np.int64)
        while len(chosen) < self.fanout and gap.max() > 0:  # each next pivot is the vector farthest from those chosen
            chosen.append(int(gap.argmax()))
            d = _distances(p, p[chosen[-1]])
            owner[d < gap] = len(chosen) - 1
            gap = np.minimum(gap, d)
        groups = [np.flatnonzero(owner == i) for i in range(len(chosen))]
        most = max(self.leaf, -(-len(rows) // 2))  # a group that is nearly all, such as of equal vectors, is cut into pages by rank
        groups = [part for g in groups if len(g) for part in (np.array_split(g, -(-len(g) // most)) if len(g) > most else [g])]
        pages, pivots, radii = [], [], []
        for g in groups:
            q = p[g].mean(axis=0)
            pivots.append(q)
            radii.append(_distances(p[g], q).max())
            pages.append(self._build(rows[g], q))
        pivots = np.array(pivots)
        return Page(pivots, _distances(pivots, pivot), np.array(radii), np.array([pg.norms.max() for pg in pages]), np.array([pg.least.min() for pg in pages]), children=pages)

    def search(self, q: np.ndarray, k: int, own: int | None, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, id) of those that score ``floor`` or more, ties to the smaller id, without ``own``."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
        if self.root is None:
            return []
        point = q.astype(np.float64)
        qq = float((point**2).sum())
        slack = 1e-9 * (qq + float(self.norms.max())) + 1e-3
        queue, turn = [(-np.inf, 0, self.root, float(np.sqrt(((point - self.center) ** 2).sum())))], 1
        while queue:
            bound, _, page, d = heapq.heappop(queue)
            least = max(floor, best[0][0]) if len(best) == k else floor
            if -bound < least:
                break
            low = np.maximum(np.abs(d - page.parent) - page.radii, 0.0)
            bounds = (qq + page.norms - low * low) / 2 + slack
            at = np.flatnonzero(bounds >= least)
            if not len(at):
                continue
            self.computed += len(at)
            if page.children is None:
                scores = page.vectors[at] @ q
                if least > -np.inf:
                    good = scores >= least
                    at, scores = at[good], scores[good]
                for s, i in zip(scores.tolist(), page.ids[at].tolist()):
                    if i != own:
                        item = (max(-LONG - 1, min(LONG, int(s))), -i)
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
                continue
            far = _distances(page.points[at], point)
            low = np.maximum(far - page.radii[at], 0.0)
            bounds = (qq + page.norms[at] - low * low) / 2 + slack
            for j, b, f in zip(at.tolist(), bounds.tolist(), far.tolist()):
                if b >= least and (len(best) < k or not (int(b) == best[0][0] and page.least[j] > -best[0][1])):
                    heapq.heappush(queue, (-b, turn, page.children[j], f))
                    turn += 1
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part: an id, and a vector without null or non-finite components."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~bad).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))


class Cells:
    """The upper level: pivots by number of components, and per cell its shards, covering radius and largest squared norm."""

    def __init__(self, pivots: list[np.ndarray]):
        self.of = {d: [i for i, p in enumerate(pivots) if len(p) == d] for d in {len(p) for p in pivots}}
        self.points = {d: np.array([pivots[i] for i in at]) for d, at in self.of.items()}
        self.shards: dict[int, int] = {}
        self.radius: dict[int, float] = {}
        self.norm: dict[int, float] = {}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of rows; which of almost equally near cells is free, the distance is not."""
        p = self.points[x.shape[1]]
        j = ((p**2).sum(axis=1)[None, :] - 2 * (x @ p.T)).argmin(axis=1)
        return np.array(self.of[x.shape[1]])[j], _distances(x, p[j])

    def bounds(self, q: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Cells that have vectors, and what an inner product with q may be there at most."""
        if len(q) not in self.of:
            return [NO_CELL], np.array([np.inf])
        known = [j for j, i in enumerate(self.of[len(q)]) if i in self.shards]
        cells = [self.of[len(q)][j] for j in known]
        far, qq = _distances(self.points[len(q)][known], q), float((q**2).sum())
        norm, radius = np.array([self.norm[i] for i in cells]), np.array([self.radius[i] for i in cells])
        low = np.maximum(far - radius * (1 + 1e-9), 0.0)
        return cells, (qq + norm - low * low) / 2 + 1e-9 * (qq + norm) + 1e-3


#: Cell of vectors of whose number of components no pivot was drawn.
NO_CELL = -1
#: Vectors whose distances to all pivots are taken at once.
BLOCK = 256


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first row, end, components, vectors) of runs of rows of one length."""
    dims = batch.column("dim").to_numpy()
    flat, offsets = batch.column("v").flatten().to_numpy(zero_copy_only=False), batch.column("v").offsets.to_numpy()
    offsets = offsets - offsets[0]
    edge = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)] if len(dims) else []
    for a, b in zip(edge, edge[1:]):
        for c in range(a, b, BLOCK):
            e = min(c + BLOCK, b)
            yield c, e, int(dims[a]), flat[offsets[c] : offsets[e]].reshape(e - c, int(dims[a]))


def cells_of(rows: DataFrame, most: int, shard: int) -> tuple[DataFrame, Cells]:
    """Written table vec_id, v, dim, cell of the vectors, and the upper level over them."""
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("vec_id", "v")).limit(max(1, min(most, -(-n // shard)))).collect()  # ``most`` vectors at most
    cells = Cells([scaled(np.array(r["v"], float)[None, :])[0].astype(float) for r in drawn])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far, norm = np.full(batch.num_rows, NO_CELL), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for a, b, dim, x in _blocks(batch):
                x = scaled(x).astype(float)
                norm[a:b] = (x**2).sum(axis=1)
                if dim in cells.of:
                    cell[a:b], far[a:b] = cells.nearest(x)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "v": batch.column("v"), "dim": batch.column("dim"), "cell": pa.array(cell, pa.int32()), "far": pa.array(far), "norm": pa.array(norm)})

    data = materialize(mapped(rows, assign, "vec_id long, v array<double>, dim int, cell int, far double, norm double"), "vector-cells")
    for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect():  # a row a cell
        cells.shards[r["cell"]], cells.radius[r["cell"]], cells.norm[r["cell"]] = -(-r["n"] // shard), r["far"], r["norm"]
    return data, cells


def routed(queries: DataFrame, cells: Cells, best: bool) -> DataFrame:
    """Queries (vec_id, v, dim, floor) once per shard that they visit: those of the cell of the highest bound, or of all others that reach the floor."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors, rows, to, part = batch.column("floor").to_numpy(zero_copy_only=False), [], [], []
            for a, b, _, x in _blocks(batch):
                for i, q in zip(range(a, b), scaled(x).astype(float)):
                    at, bounds = cells.bounds(q)
                    first = int(bounds.argmax())
                    for j in [first] if best else np.flatnonzero(bounds >= floors[i]).tolist():
                        if best or j != first:
                            for p in range(cells.shards.get(at[j], 1)):
                                rows.append(i)
                                to.append(at[j])
                                part.append(p)
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_pydict({c: out.column(c) for c in ("vec_id", "v", "dim", "floor")} | {"cell": pa.array(to, pa.int32()), "part": pa.array(part, pa.int32())})

    return mapped(queries, route, "vec_id long, v array<double>, dim int, floor double, cell int, part int")


def searched(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, q, vec_id, score: the k best per query and shard that reach the query's floor."""
    one = data.select("vec_id", "v", "dim", F.lit(None).cast("double").alias("floor"), "cell", "part", F.lit(0).alias("kind"))
    mixed = one.unionByName(queries.withColumn("kind", F.lit(1)))
    keys = ["cell", "part", "dim"]
    mixed = mixed.repartition(partitions(data.sparkSession), *keys).sortWithinPartitions(*keys, "kind", "vec_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ids, parts, tree = None, [], [], None
        for batch in batches:
            out: list[tuple[int, bytes, int, int]] = []
            names = list(zip(*(batch.column(c).to_pylist() for c in (*keys, "kind"))))
            flat, offsets = batch.column("v").flatten().to_numpy(zero_copy_only=False), batch.column("v").offsets.to_numpy()
            offsets = offsets - offsets[0]
            vec_ids, floors = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "floor"))
            a = 0
            while a < len(names):
                b = a
                while b < len(names) and names[b] == names[a]:
                    b += 1
                *shard, kind = names[a]
                if of != shard:
                    of, ids, parts, tree = shard, [], [], None
                x = flat[offsets[a] : offsets[b]].reshape(b - a, shard[-1])
                if kind == 0:
                    ids.append(vec_ids[a:b])
                    parts.append(x)
                elif parts:
                    if tree is None:
                        tree = MTree(np.concatenate(ids), scaled(np.concatenate(parts)))
                        parts = [np.zeros((1, shard[-1]))]
                    for i, raw, floor in zip(vec_ids[a:b].tolist(), x, floors[a:b].tolist()):
                        q = scaled(raw[None, :])[0]
                        if tree.x.dtype != q.dtype or np.abs(tree.points).max(initial=1) * np.abs(q.astype(float)).max(initial=1) * len(q) >= 2.0**52:
                            q = np.array([int(v) for v in q], object)
                            tree.exact()
                        out += [(i, raw.tobytes(), v, sc) for sc, v in tree.search(q, k, i, floor)]
                a = b
            yield pa.RecordBatch.from_pydict({"query_id": pa.array([r[0] for r in out], pa.int64()), "q": pa.array([r[1] for r in out], pa.binary()), "vec_id": pa.array([r[2] for r in out], pa.int64()), "score": pa.array([r[3] for r in out], pa.int64())})

    return mapped(mixed, search, "query_id long, q binary, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, shard: int = SHARD, most_cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by ``every``.

    Rows whose vector is null or holds a null or non-finite component, and rows without vec_id, take no part.
    Vectors of different lengths don't compare.  Rows that share the query's vec_id count as its own; repeated
    query rows give one result, candidates that are repeated each take a rank.  Scores beyond a long are set to its ends.
    """
    rows = materialize(usable(vectors).withColumn("dim", F.size("v")), "vectors")
    data, cells = cells_of(rows, most_cells, shard)
    shards = F.create_map(*(F.lit(x) for kv in (cells.shards or {NO_CELL: 1}).items() for x in kv))
    data = data.select("vec_id", "v", "dim", "cell", F.pmod(F.xxhash64("vec_id"), shards[F.col("cell")]).cast("int").alias("part"))
    queries = rows.filter(F.col("vec_id") % every == 0).distinct()
    first = materialize(searched(data, routed(queries.withColumn("floor", F.lit(float("-inf"))), cells, True), k), "vectors-first")
    worst = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id"))
    floors = first.withColumn("_r", worst).filter(F.col("_r") == k).select(F.col("query_id").alias("vec_id"), F.when(F.col("score") > -LONG, F.col("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("floor"))
    floors = floors.groupBy("vec_id").agg(F.min("floor").alias("floor"))  # of several query rows of one id the least
    again = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    rest = materialize(searched(data, routed(again, cells, False), k), "vectors-rest")
    rank = F.row_number().over(Window.partitionBy("query_id", F.xxhash64("q")).orderBy(F.col("score").desc(), "vec_id"))
    found = materialize(first.unionByName(rest).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "vectors-found")
    discard(rows, data, first, rest)
    return found


def op6_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
