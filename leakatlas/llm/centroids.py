"""Clustering around centroids, exact in integers, with a vantage-point tree over the centroids.

Vectors of ``dims`` finite components become integers ``floor(scale * x)``. Each
round builds a tree over the centroids, broadcasts it (its size is given by the
number of centroids and components, not by the data), and every vector searches
it best first: the open node with the smallest lower bound is taken, until the
smallest bound exceeds the best distance found. Bounds come from the triangle
inequality over the interval of distances between a vantage point and the
members of a child; a node at a bound equal to the best distance is still
opened, so that of equally near centroids the smaller number wins. Distances of
vectors to centroids are exact integers. Tasks reduce their vectors to one
count and one sum a centroid before anything is shuffled, and only these sums
(centroids x components) reach the driver.

Null vectors, vectors of another length and those with a null, infinite or NaN
component are left out, also those with a component beyond +-2**27 after
scaling, whose squared distances do not fit 64 bits. Vectors with a null id are
clustered but never start a centroid. Repeated rows count as often as they
occur. With fewer vectors than centroids every vector starts one; without any
the result is empty. A centroid without vectors stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from leakatlas.llm.shared import stored

LARGEST = 1 << 27
LEAF = 4
BATCH = 4096
SLACK = 1e-9


class VantageTree:
    """A vantage-point tree over the rows of ``points``, as flat arrays.

    Node 0 is the root. An inner node has a vantage point and up to two children,
    each with the least and greatest distance of its members from that point; a
    leaf has up to LEAF points.
    """

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.int64)
        self.members: list[np.ndarray] = []  # the vantage point of an inner node, the points of a leaf
        self.children: list[list[tuple[int, float, float]]] = []
        if len(points):
            self._grow(np.arange(len(points)))

    def _grow(self, of: np.ndarray) -> int:
        node = len(self.members)
        self.members.append(of)
        self.children.append([])
        if len(of) <= LEAF:
            return node
        # The vantage point: the member farthest from the middle of the others spreads their distances most.
        middle = self.points[of].mean(axis=0)
        at = int(np.argmax(((self.points[of] - middle) ** 2).sum(axis=1)))
        vantage, rest = of[at], np.delete(of, at)
        far = np.sqrt(((self.points[rest] - self.points[vantage]) ** 2).sum(axis=1).astype(np.float64))
        order = np.argsort(far, kind="stable")
        self.members[node] = np.array([vantage])
        for half in np.array_split(order, 2):
            child = self._grow(rest[half])
            self.children[node].append((child, float(far[half[0]]), float(far[half[-1]])))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest point of every vector (the smallest of equally near ones) and squared distance.

        All vectors search at once, each by its own order: ``bound`` holds a row of
        open nodes for every vector.
        """
        n, nodes = len(vectors), len(self.members)
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, len(self.points))
        bound = np.full((n, nodes), np.inf)
        bound[:, 0] = 0.0
        live = np.arange(n)
        while len(live):
            picked = np.argmin(bound[live], axis=1)
            least = bound[live, picked]
            # Inclusive: equal bounds are opened. SLACK covers the rounding of square roots.
            open_ = least * (1 - SLACK) - SLACK <= np.sqrt(best[live].astype(np.float64))
            live, picked, least = live[open_ & np.isfinite(least)], picked[open_ & np.isfinite(least)], least[open_ & np.isfinite(least)]
            bound[live, picked] = np.inf
            order = np.argsort(picked, kind="stable")
            cuts = np.flatnonzero(np.diff(picked[order])) + 1
            for part in np.split(order, cuts):
                if len(part):
                    self._visit(int(picked[part[0]]), live[part], least[part], vectors, best, number, bound)
        return number, best

    def _visit(self, node: int, rows: np.ndarray, least: np.ndarray, vectors: np.ndarray, best: np.ndarray, number: np.ndarray, bound: np.ndarray) -> None:
        for point in self.members[node]:
            off = vectors[rows] - self.points[point]
            square = np.einsum("ij,ij->i", off, off)
            nearer = (square < best[rows]) | ((square == best[rows]) & (point < number[rows]))
            best[rows[nearer]], number[rows[nearer]] = square[nearer], point
        if self.children[node]:  # the one member was the vantage point
            far = np.sqrt(square.astype(np.float64))
            for child, low, high in self.children[node]:
                bound[rows, child] = np.maximum(least, np.maximum(low - far, far - high))


def integer_vectors(df: DataFrame, vector: str, dims: int, scale: int) -> DataFrame:
    """``df`` without rows that cannot be clustered, its vector as integers ``__v``."""
    x = F.col(f"`{vector}`").cast("array<double>")
    scaled = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c))
    fit = F.forall(x, lambda c: F.coalesce((F.lit(float(scale)) * c >= -LARGEST) & (F.lit(float(scale)) * c <= LARGEST) & ~F.isnan(c), F.lit(False)))
    return df.filter(x.isNotNull() & (F.size(x) == dims)).filter(fit).withColumn("__v", scaled.cast("array<int>"))


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            yield batch, batch.column("__v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _sums(vectors: DataFrame, tree: Any, k: int, dims: int) -> dict[int, tuple[int, dict[int, int]]]:
    """Of each centroid with vectors: their number and the sum of every component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, v in _blocks(batches, dims):
            number, _ = tree.value.nearest(v)
            counts += np.bincount(number, minlength=k)
            if not len(v):
                continue
            order = np.argsort(number, kind="stable")
            first = np.flatnonzero(np.diff(number[order], prepend=-1))
            sums[number[order][first]] += np.add.reduceat(v[order], first, axis=0)
        held = np.flatnonzero(counts)
        if len(held):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(held, dims), pa.int32()),
                    pa.array(np.tile(np.arange(dims), len(held)), pa.int32()),
                    pa.array(np.repeat(counts[held], dims), pa.int64()),
                    pa.array(sums[held].reshape(-1), pa.int64()),
                ],
                names=["cluster", "dim", "n", "total"],
            )

    parts = vectors.select("__v").mapInArrow(run, "cluster int, dim int, n long, total long")
    rows = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in rows:
        out.setdefault(r.cluster, (int(r.n), {}))[1][r.dim] = int(r.total)
    return out


def starting_centroids(vectors: DataFrame, key: str, k: int, seed: int) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of ``seed:key``, in that order; equal ids by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")), 256)
    rows = vectors.filter(F.col(f"`{key}`").isNotNull()).select(digest.alias("h"), "__v").orderBy("h", "__v").limit(k).collect()
    return np.array([r["__v"] for r in rows], np.int64)


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """Key, cluster, distance (squared), cluster_inertia, inertia and centroid (its components) of every vector."""
    spark: SparkSession = df.sparkSession
    vectors = stored(integer_vectors(df, vector, dims, scale).select(F.col(f"`{key}`"), "__v"), "cluster-vectors")
    centroids = starting_centroids(vectors, key, k, seed)
    if not len(centroids):
        return vectors.limit(0).select(
            F.col(f"`{key}`"), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid")
        )
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))
        for number, (n, total) in _sums(vectors, tree, len(centroids), dims).items():
            centroids[number] = [total[d] // n for d in range(dims)]
        tree.unpersist()
    last = spark.sparkContext.broadcast(VantageTree(centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v in _blocks(batches, dims):
            number, square = last.value.nearest(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(square, pa.int64())], names=["k", "cluster", "distance"])

    kind = vectors.schema[0].dataType.simpleString()
    assigned = stored(vectors.mapInArrow(assign, f"k {kind}, cluster int, distance long"), "cluster-assigned")
    inertia = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row a centroid
    total = sum(int(r.s) for r in inertia)
    facts = spark.createDataFrame(
        [(r.cluster, int(r.s), total, ",".join(map(str, centroids[r.cluster].tolist()))) for r in inertia],
        "cluster int, cluster_inertia long, inertia long, centroid string",
    )
    return assigned.join(F.broadcast(facts), "cluster").select(F.col("k").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


