"""Clusters around moving centroids, in integers: a vantage-point tree over the centroids finds each vector's nearest.

The tree is built anew from the centroids of every round and broadcast.  Every vector searches it best-first: the node
with the smallest possible distance is opened next, a node is left out only if nothing inside can be as near as the best
so far (the pruning radius is inclusive, so that equally near centroids of smaller numbers are seen), and distances are
exact integers.  A batch of vectors searches in step; each has its own frontier and its own best.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

CLUSTERS, ROUNDS, DIM, SCALE = 8, 10, 64, 1024
#: Components beyond this would take squared distances out of 63 bits: an error.
LARGEST = float(1 << 17)
#: Centroids in a leaf of the tree, at most.
LEAF = 2
#: Vectors that search in step.
STEP = 4096
#: Relative slack of bounds, far above the rounding of roots and far below what pruning is for.
SLACK = 1e-9


class VantageTree:
    """Nodes with a vantage point, which is itself a centroid, and two halves at known ranges of distance from it.

    ``points`` of a node are compared exactly when it is opened: the vantage point of an inner node, all of a leaf.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.points: list[list[int]] = []
        self.halves: list[list[tuple[int, float, float]]] = []
        if len(centroids):
            self._build(list(range(len(centroids))))

    def _build(self, members: list[int]) -> int:
        node = len(self.points)
        self.points.append(members)
        self.halves.append([])
        if len(members) > LEAF:
            # The member farthest from the first one sees the others at the most different distances.
            away = distances(self.centroids[members], self.centroids[members[:1]])[:, 0]
            vantage = members[int(away.argmax())]
            rest = [m for m in members if m != vantage]
            squares = distances(self.centroids[rest], self.centroids[[vantage]])[:, 0]
            order = np.argsort(squares, kind="stable")
            self.points[node] = [vantage]
            for half in (order[: (len(order) + 1) // 2], order[(len(order) + 1) // 2 :]):
                if len(half):
                    radii = np.sqrt(squares[half].astype(float))
                    self.halves[node].append((self._build([rest[i] for i in half.tolist()]), radii.min() * (1 - SLACK), radii.max() * (1 + SLACK)))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid of each vector, ties to the smaller number; distances taken."""
        n, taken = len(vectors), 0
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
        # What may lie in a node is at least this far away; infinite: not in the frontier.
        frontier = np.full((n, len(self.points)), np.inf)
        frontier[:, 0] = 0.0
        live = np.arange(n)
        while len(live):
            node = frontier[live].argmin(axis=1)
            bound = frontier[live, node]
            # Inclusive: a bound equal to the best distance is still opened.
            go = bound <= np.sqrt(best[live].astype(float)) * (1 + SLACK)
            live, node, bound = live[go], node[go], bound[go]
            frontier[live, node] = np.inf
            for k in np.unique(node).tolist():
                rows = live[node == k]
                squares = distances(vectors[rows], self.centroids[self.points[k]])
                taken += squares.size
                for j, c in enumerate(self.points[k]):
                    d = squares[:, j]
                    won = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
                    best[rows[won]], number[rows[won]] = d[won], c
                root = np.sqrt(squares[:, 0].astype(float))
                for child, low, high in self.halves[k]:
                    least = np.maximum(low - root * (1 + SLACK), root * (1 - SLACK) - high)
                    frontier[rows, child] = np.maximum(np.maximum(least, 0.0), bound[node == k])
            live = live[np.isfinite(frontier[live].min(axis=1))] if len(live) else live
        return number, best, taken


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a to those of b."""
    out = np.empty((len(a), len(b)), np.int64)
    for j, row in enumerate(b):
        out[:, j] = np.square(a - row).sum(axis=1)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _found(batch, tree):
    vectors = _matrix(batch.column("v"))
    for first in range(0, len(vectors), STEP):
        own = vectors[first : first + STEP]
        yield first, own, *tree.nearest(own)[:2]


def _sums(batches, tree):
    """Numbers and componentwise sums of the vectors of each centroid in a partition."""
    sums, counts = None, None
    for batch in batches:
        for _, own, number, _ in _found(batch, tree.value):
            if sums is None:
                sums, counts = np.zeros((len(tree.value.centroids), own.shape[1]), np.int64), np.zeros(len(tree.value.centroids), np.int64)
            np.add.at(sums, number, own)
            counts += np.bincount(number, minlength=len(counts))
    if sums is not None:
        c = np.flatnonzero(counts)
        dim = sums.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(c, dim)), pa.array(np.tile(np.arange(dim), len(c))), pa.array(sums[c].ravel()), pa.array(np.repeat(counts[c], dim))], ["cluster", "ix", "s", "n"]
        )


def _assigned(batches, tree):
    for batch in batches:
        number, distance = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for first, own, k, d in _found(batch, tree.value):
            number[first : first + len(own)], distance[first : first + len(own)] = k, d
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])


def kept_vectors(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors of ``dim`` finite components, each component x as the integer floor(scale * x)."""
    whole = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    wide = F.raise_error(F.lit(f"a component beyond {LARGEST:.0f} has no exact distance in 63 bits")).cast("bigint")
    integer = lambda x: F.when(F.abs(x) <= LARGEST * SCALE / scale, F.floor(x.cast("double") * scale).cast("bigint")).otherwise(wide)
    return embeddings.where(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform("embedding", integer).alias("v"))


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Clusters vectors; per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Args: embeddings with ``vec_id`` and ``embedding``.  The first centroids are the vectors whose ids have the smallest
    hashes.  Each round adds up integers where the vectors are, and the driver gets ``clusters * dim`` sums.

    Defined cases: null vectors and those with a null, a non-finite or the wrong number of components are left out;
    repeated rows are vectors each; null ids hash last; equal hashes (repeated ids) go by components; equal distances go
    to the smaller number; fewer vectors than ``clusters`` give as many centroids; an empty centroid stays where it is;
    components beyond LARGEST are an error; an empty table gives no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    kept = kept_vectors(embeddings, dim, scale)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(hashed.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    kind = kept.schema["vec_id"].dataType.simpleString()
    if not first:
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in _COLUMNS.items()])
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))
        sums = kept.select("v").mapInArrow(lambda b, t=tree: _sums(b, t), "cluster long, ix long, s long, n long")
        found = sums.groupBy("cluster", "ix").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()  # clusters * dim rows at most
        centroids = centroids.copy()
        centroids[found["cluster"].to_numpy(), found["ix"].to_numpy()] = found["s"].to_numpy() // found["n"].to_numpy()
    tree = spark.sparkContext.broadcast(VantageTree(centroids))
    out = saved(kept.mapInArrow(lambda b: _assigned(b, tree), f"vec_id {kind}, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    about = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    sides = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(sides), "cluster").select("vec_id", *_COLUMNS)


_COLUMNS = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM"
        " (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT 8))",
    ]
    near = (
        "a{k} AS MATERIALIZED (SELECT vec_id, v, m.c AS c, m.d AS d FROM (SELECT vec_id, v, (SELECT min({{'d': list_sum(list_transform(list_zip(kept.v, c{k}.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 'c': c}})"
        " FROM c{k}) AS m FROM kept))"
    )
    for k in range(ROUNDS):
        steps.append(near.format(k=k))
        steps.append(
            f"n{k} AS MATERIALIZED (SELECT c, list(q ORDER BY ix) AS v FROM (SELECT c, ix, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS q"
            f" FROM (SELECT c, ix, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS ix FROM a{k}) GROUP BY c, ix)) GROUP BY c)"
        )
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(n{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN n{k} USING (c))")
    steps.append(near.format(k=ROUNDS))
    last = f"a{ROUNDS}"
    return (
        "WITH " + ",\n".join(steps) + f" SELECT {last}.vec_id, CAST({last}.c AS INTEGER) AS cluster, CAST({last}.d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY {last}.c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256 FROM {last} JOIN c{ROUNDS} USING (c)"
    )


QUERIES = {"op12_centroids": op12_centroids}
ORACLES = {"op12_centroids": _oracle()}
