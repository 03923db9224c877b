"""Clusters of vectors around moving centroids, in whole numbers, by partial-distance search.

Vectors become whole numbers, ``floor(SCALE * x)``, so that sums, means and distances are exact and do not depend on how
the rows are dealt.  Each round reads the written vectors once: a task compares its vectors with all
centroids and gives one row of sums for each cluster; a round's outcome is ``k`` rows.  Nothing but these
is shuffled, so copies of one vector, however many, stay where they are.

Partial-distance search: a vector's squared differences to a centroid are added up over the dimensions of
largest variance first, a few at a time; once the sum is strictly above the vector's best distance so far the centroid is
given up for it; the vectors that remain finish all dimensions.

Defined results: vectors that are null, of another size or with a null or non-finite component are left
out; components beyond 2^27 in amount count as that much, so that every distance fits its type; with fewer vectors than
centroids each vector starts one; of equal hashes (repeated ids) the lesser components come first; repeated rows are vectors each, and
their centroids may coincide (the smaller number wins, the other keeps its place); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
LARGEST = 1 << 27
#: Dimensions that are added up between two looks at the best distance.
STRIDE = 8
#: Vectors that a task compares at once.
TOGETHER = 16_384


def whole_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and the vector in whole numbers, of the vectors that count."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(v * F.lit(float(scale))), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return vectors.where(F.coalesce((F.size("embedding") == size) & finite, F.lit(False))).select("vec_id", whole.alias("v"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


def nearest(rows: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (the smaller number of equals) and the squared distance to it."""
    rows, centroids = np.ascontiguousarray(rows[:, order]), centroids[:, order]
    best = np.full(len(rows), np.iinfo(np.int64).max)
    which = np.zeros(len(rows), np.int32)
    for number, centre in enumerate(centroids):
        open_rows = np.arange(len(rows))
        summed = np.zeros(len(rows), np.int64)
        for at in range(0, rows.shape[1], STRIDE):
            gap = rows[open_rows, at : at + STRIDE] - centre[at : at + STRIDE]
            summed += np.einsum("ij,ij->i", gap, gap)
            hopeful = summed <= best[open_rows]
            if not hopeful.all():
                open_rows, summed = open_rows[hopeful], summed[hopeful]
        closer = summed < best[open_rows]
        best[open_rows[closer]] = summed[closer]
        which[open_rows[closer]] = number
    return which, best


def totals(parts: DataFrame) -> dict[int, list]:
    """The sums of the tasks' rows of figures (cluster, figures), a row for each cluster."""
    each = parts.select("cluster", F.posexplode("figures").alias("place", "x")).groupBy("cluster", "place").agg(F.sum("x").alias("x"))
    found = each.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("all"))
    return {r.cluster: [x.x for x in r["all"]] for r in found.collect()}  # a row for each centroid


def figures(rows: list[tuple[int, list]], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.list_(kind))], ["cluster", "figures"])


def spread(vectors: DataFrame, size: int) -> np.ndarray:
    """The dimensions, those of largest variance first."""

    def moments(batches):
        n, sums, squares = 0, np.zeros(size), np.zeros(size)
        for batch in batched(batches):
            rows = matrix(batch).astype(np.float64)
            n, sums, squares = n + len(rows), sums + rows.sum(axis=0), squares + (rows * rows).sum(axis=0)
        yield figures([(0, [float(n), *sums, *squares])], pa.float64())

    n, *x = totals(vectors.select("v").mapInArrow(moments, "cluster int, figures array<double>"))[0]
    mean, square = np.array(x[:size]) / n, np.array(x[size:]) / n
    return np.argsort(mean * mean - square, kind="stable")


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floored means of the vectors nearest to each; those without any stay."""
    k, size = centroids.shape

    def sums(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batched(batches):
            rows = matrix(batch)
            which, _ = nearest(rows, centroids, order)
            n += np.bincount(which, minlength=k)
            for c in np.unique(which):
                total[c] += rows[which == c].sum(axis=0)
        yield figures([(int(c), [n[c], *total[c]]) for c in np.nonzero(n)[0]], pa.int64())

    out = centroids.copy()
    for c, (n, *x) in totals(vectors.select("v").mapInArrow(sums, "cluster int, figures array<long>")).items():
        out[c] = [s // n for s in x]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    def place(batches):
        for batch in batched(batches):
            which, far = nearest(matrix(batch), centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(which, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(place, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``cluster`` and ``distance`` of each vector, and the centroids."""
    kept = cut(whole_vectors(vectors, size, scale))
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return kept.selectExpr("vec_id", "0 cluster", "0L distance"), centroids
    order = spread(kept, size)
    for _ in range(rounds):
        before, centroids = centroids, moved(kept, centroids, order)
        if (before == centroids).all():  # the rounds that are left would change nothing
            break
    found = cut(assigned(kept, centroids, order))
    drop(kept)
    return found, centroids


def cluster_vectors(vectors: DataFrame) -> DataFrame:
    """Each vector's cluster and distance with the inertia of the cluster and of all and the centroid's digest."""
    found, centroids = clustered(vectors)
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row for each centroid
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids] or [""]
    of_cluster = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(digests))])
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(of_cluster, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, digests)), F.col("cluster")).alias("centroid_sha256"),
    )
