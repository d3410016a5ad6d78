"""Centroid clustering of integer vectors with Drake's adaptive bounds.

A vector carries, in a written table, its cluster, an upper bound of the distance to it, lower bounds of the distances to the next
nearest centroids, in their order, and one lower bound for all centroids that remain.  When the centroids have moved,
bounds move by as much; only the centroids before the first bound that exceeds the upper bound are measured again, all of them if
even the remainder's doesn't.  Bounds are doubles rounded outwards and certify nothing but strict order; whatever they don't decide is decided by exact
integer distances, ties by the smaller number.  How many bounds the next round keeps is the most that a vector has needed.
A pass also leaves each task's sums by cluster in its table, as limbs of integers that Spark adds up, so vectors are read once a round and
only a table of centroids, of fixed size, passes through the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, mapped, materialize, table

K, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64.0, 1
#: Largest integer up to which all doubles are exact, and bits of a limb of a sum.
EXACT, LIMB = 2.0**53, 30
LONG = 2**63 - 1
#: Rows besides vectors in a pass's table: sums have the number of a component.
COUNT, DEPTH = -1, -2
STATE = "vec_id long, x array<double>, cluster int, upper double, near array<int>, lower array<double>, distance long, component int, limb int, value long"


def grown(d: np.ndarray) -> np.ndarray:
    return d * (1 + 1e-12) + 1e-9


def shrunk(d: np.ndarray) -> np.ndarray:
    return d * (1 - 1e-12) - 1e-9


def whole(x: np.ndarray) -> np.ndarray:
    """The same numbers as Python's integers."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


@dataclass
class Centroids:
    """``rows``: a list of integers each; ``moved``: how far each has moved since the pass before, rounded up."""

    rows: list[list[int]]
    moved: np.ndarray | None = None
    keep: int = 0

    def __post_init__(self) -> None:
        self.largest = max((abs(v) for r in self.rows for v in r), default=0)
        self.exact = np.array(self.rows, object).reshape(len(self.rows), -1)
        self.fast = self.exact.astype(np.float64) if self.largest < EXACT else None

    def replaced(self, rows: list[list[int]], keep: int) -> Centroids:
        gaps = [sum((a - b) ** 2 for a, b in zip(r, s)) for r, s in zip(self.rows, rows)]
        return Centroids(rows, grown(np.array([math.sqrt(g) if g < 1e300 else np.inf for g in gaps])), keep)


def squared(x: np.ndarray, centroids: Centroids, ids: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of each row to all centroids, or to those in its row of ``ids``; ``x`` must be of Python integers unless all are exact in doubles."""
    c = centroids.exact if x.dtype == object else centroids.fast
    if ids is not None:
        return ((x[:, None, :] - c[ids]) ** 2).sum(axis=2)
    return np.stack([((x - r) ** 2).sum(axis=1) for r in c], axis=1)


@dataclass
class Bounds:
    """Of the rows of a batch; ``lower`` has a column more than ``near``, the remainder's."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    depth: int = 0
    measured: int = 0


def scan(x: np.ndarray, centroids: Centroids, keep: int) -> Bounds:
    """Bounds from all distances: the nearest centroid, the next ``keep`` and the remainder."""
    n, k = len(x), len(centroids.rows)
    keep = max(0, min(keep, k - 1))
    d = squared(x, centroids)
    if d.dtype == object:  # beyond doubles: these bounds certify nothing, so every pass measures anew
        order = np.array([sorted(range(k), key=r.__getitem__) for r in d.tolist()], np.int64).reshape(n, k)
        upper, lower = np.full(n, np.inf), np.full((n, keep + 1), -np.inf)
    else:
        order = np.argsort(d, axis=1, kind="stable")  # ties to the smaller number
        root = np.sqrt(np.take_along_axis(d, order[:, : keep + 2], axis=1))
        upper, lower = grown(root[:, 0]), np.full((n, keep + 1), np.inf)
        lower[:, : root.shape[1] - 1] = shrunk(root[:, 1:])
    return Bounds(order[:, 0], upper, order[:, 1 : keep + 1], lower, keep + 1, n * k)


def follow(x: np.ndarray, b: Bounds, centroids: Centroids) -> Bounds:
    """The bounds of the pass before, brought to centroids that have moved; cut to ``centroids.keep``."""
    moved, keep = centroids.moved, min(centroids.keep, b.near.shape[1])
    if x.dtype == object:
        return scan(x, centroids, keep)
    cluster, near = b.cluster.copy(), b.near.copy()
    upper, lower = grown(b.upper + moved[cluster]), b.lower.copy()
    with np.errstate(invalid="ignore"):
        lower[:, :-1] -= moved[near]
        lower[:, -1] -= moved.max(initial=0.0)
    lower = np.nan_to_num(shrunk(lower), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    lower = np.hstack([lower[:, :keep], lower[:, keep:].min(axis=1, keepdims=True)])
    near = near[:, :keep]
    out = Bounds(cluster, upper, near, lower)

    def position(at: np.ndarray) -> np.ndarray:
        """The first bound from which on all exceed the upper bound; keep + 1 if not even the last does."""
        least = np.minimum.accumulate(lower[at, ::-1], axis=1)[:, ::-1]
        return (least <= upper[at, None]).sum(axis=1)

    open_at = np.flatnonzero(position(np.arange(len(x))) > 0)
    if not len(open_at):
        return out
    own = squared(x[open_at], centroids, cluster[open_at, None])[:, 0]
    upper[open_at] = grown(np.sqrt(own))
    out.measured += len(open_at)
    z = position(open_at)
    out.depth = int(z.max(initial=0))
    for depth in np.unique(z[z > 0]).tolist():
        rows = open_at[z == depth]
        if depth > keep:
            new = scan(x[rows], centroids, keep)
            cluster[rows], upper[rows], near[rows], lower[rows] = new.cluster, new.upper, new.near, new.lower
            out.measured += new.measured
            continue
        ids = np.sort(np.hstack([cluster[rows, None], near[rows, :depth]]), axis=1)
        d = squared(x[rows], centroids, ids)
        order = np.argsort(d, axis=1, kind="stable")
        ids, root = np.take_along_axis(ids, order, axis=1), np.sqrt(np.take_along_axis(d, order, axis=1))
        cluster[rows], upper[rows], near[rows, :depth], lower[rows, :depth] = ids[:, 0], grown(root[:, 0]), ids[:, 1:], shrunk(root[:, 1:])
        out.measured += ids.size
    return out


class Sums:
    """Exact sums by cluster and component of a task's vectors."""

    def __init__(self, k: int, dim: int):
        self.total, self.counts, self.depth = np.zeros((k, dim), object), np.zeros(k, np.int64), 0

    def add(self, x: np.ndarray, cluster: np.ndarray) -> None:
        for c in np.unique(cluster).tolist():
            rows = x[cluster == c]
            self.counts[c] += len(rows)
            if rows.dtype != object and np.abs(rows).max(initial=0.0) * len(rows) >= EXACT:
                rows = whole(rows)
            self.total[c] += whole(rows.sum(axis=0))

    def rows(self) -> list[tuple[int, int, int, int]]:
        """(cluster, component, limb, value): a number is the sum of value << (LIMB * limb)."""
        out = [(0, DEPTH, 0, self.depth)] + [(c, COUNT, 0, n) for c, n in enumerate(self.counts.tolist()) if n]
        for c, i in zip(*np.nonzero(self.counts[:, None] > np.zeros(self.total.shape[1]))):
            v, sign, limb = abs(self.total[c, i]), -1 if self.total[c, i] < 0 else 1, 0
            while v:
                out.append((int(c), int(i), limb, sign * (v & ((1 << LIMB) - 1))))
                v, limb = v >> LIMB, limb + 1
        return out


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), kind))


_TYPES = {"vec_id": pa.int64(), "x": pa.list_(pa.float64()), "cluster": pa.int32(), "upper": pa.float64(), "near": pa.list_(pa.int32()), "lower": pa.list_(pa.float64()), "distance": pa.int64(), "component": pa.int32(), "limb": pa.int32(), "value": pa.int64()}


def _pass(state: DataFrame, centroids: Centroids, first: bool, last: bool) -> DataFrame:
    """One assignment of all vectors, written: STATE rows of vectors, after each task's those of its sums.  The last has distances, and no vectors."""
    k, dim = len(centroids.rows), len(centroids.rows[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(k, dim)
        batch_of = lambda n, cols: pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(n, t)).cast(t) for c, t in _TYPES.items()], list(_TYPES))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("x"), dim, np.float64)
            if (max(np.abs(x).max(), float(centroids.largest)) * 2) ** 2 * dim >= EXACT:
                x = whole(x)
            if first:
                b = scan(x, centroids, centroids.keep)
            else:
                width = len(batch.column("near").flatten()) // n
                old = Bounds(batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), _matrix(batch.column("near"), width, np.int64), _matrix(batch.column("lower"), width + 1, np.float64))
                b = follow(x, old, centroids)
            cols = {"vec_id": batch.column("vec_id"), "cluster": pa.array(b.cluster)}
            if last:
                own = squared(x, centroids, b.cluster[:, None])[:, 0].tolist()
                cols["distance"] = pa.array([int(d) if d <= LONG else None for d in own], pa.int64())
            else:
                sums.add(x, b.cluster)
                sums.depth = max(sums.depth, b.depth)
                cols |= {"x": batch.column("x"), "upper": pa.array(b.upper), "near": _lists(b.near, pa.int32()), "lower": _lists(b.lower, pa.float64())}
            yield batch_of(n, cols)
        if not last:
            rows = list(zip(*sums.rows()))
            yield batch_of(len(rows[0]), {c: pa.array(v, _TYPES[c]) for c, v in zip(("cluster", "component", "limb", "value"), rows)})

    return materialize(mapped(state, run, STATE), "drake")


def vectors(embeddings: DataFrame, dim: int = DIM, scale: float = SCALE) -> DataFrame:
    """vec_id, x: floor(scale * component), as doubles, which hold these integers exactly, of vectors with exactly ``dim`` components whose scaled values are all finite."""
    x = F.transform("embedding", lambda v: v.cast("double") * F.lit(scale))
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.size("embedding") == dim, x).alias("x")).filter(F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < F.lit(math.inf)) & ~F.isnan(v)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _lists(np.floor(_matrix(b.column("x"), dim, np.float64)) + 0.0, pa.float64())], ["vec_id", "x"])

    return mapped(kept, run, "vec_id long, x array<double>")


def _next(state: DataFrame, centroids: Centroids) -> Centroids:
    """Each centroid replaced by the floor of its vectors' mean; without vectors it stays."""
    k, dim = len(centroids.rows), len(centroids.rows[0])
    found = state.filter("component IS NOT NULL").groupBy("cluster", "component", "limb").agg(F.sum("value").alias("s"), F.max("value").alias("m")).collect()  # k * (dim * few limbs + 1) rows
    total, counts, depth = [[0] * dim for _ in range(k)], [0] * k, 0
    for r in found:
        if r["component"] == COUNT:
            counts[r["cluster"]] = r["s"]
        elif r["component"] == DEPTH:
            depth = r["m"]
        else:
            total[r["cluster"]][r["component"]] += r["s"] << (LIMB * r["limb"])
    rows = [[v // n for v in t] if n else old for t, n, old in zip(total, counts, centroids.rows)]
    return centroids.replaced(rows, max(1, k // 8, min(depth, centroids.keep)))


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256: a row per kept row of ``embeddings``.

    A vector of another length, null or with a null or non-finite component is left out.  Rows with the same vec_id, or without one, are
    vectors of their own; seeds that tie in the hash (a null id counts as empty) go by their components.  With fewer than ``k`` vectors each is a seed.
    A distance, or a sum of them, that no long holds is null.  An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    start = vectors(embeddings, dim, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = [[int(v) for v in r["x"]] for r in start.orderBy(order, "x").limit(k).select("x").collect()]  # k rows
    if not seeds:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = Centroids(seeds, keep=max(1, len(seeds) // 4))
    state = start
    for i in range(rounds + 1):
        after = _pass(state, centroids, i == 0, i == rounds)
        if i:
            discard(state)
        if i < rounds:
            centroids = _next(after, centroids)
            state = after.filter("component IS NULL")
    whole_sum = lambda: F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(20,0)")))
    sums = {r["cluster"]: r["s"] for r in after.groupBy("cluster").agg(whole_sum().alias("s")).collect()}  # k rows
    long = lambda s: int(s) if s is not None and s <= LONG else None
    everything = None if None in sums.values() else long(sum(sums.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = spark.createDataFrame([(c, long(s), everything, digest(centroids.rows[c])) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return after.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # facts: k rows


def op12_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> str:
    """All distances of all rounds."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({int(SCALE)} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, x FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT vec_id, x, min(struct_pack(d := d, c := c)) AS best FROM (SELECT v.vec_id, v.x, c.c, CAST(list_sum(list_transform(range(1, {dim + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT) AS d FROM v, c{i} AS c) GROUP BY vec_id, x)"
        )
        if i < rounds:
            parts.append(
                f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{i} AS o LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM "
                f"(SELECT best.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{i}, range(1, {dim + 1}) AS r(i) GROUP BY ALL) GROUP BY c) AS m USING (c))"
            )
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(list_transform(c.x, lambda e: CAST(e AS VARCHAR)), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} AS c ON c.c = best.c"
    )


SQL = _sql()
