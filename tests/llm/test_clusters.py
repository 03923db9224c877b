import hashlib
import math

import numpy as np

from marlstone.llm import clusters

NAN, INF = float("nan"), float("inf")


def by_hand(rows, k=8, rounds=10):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-(2**27), min(2**27, math.floor(1024 * float(np.float32(x))))) for x in v]))
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        members = {}
        for (_, v), (_, n) in zip(kept, assign()):
            members.setdefault(n, []).append(v)
        centroids = [[sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else c for n, c in enumerate(centroids)]
    found = assign() if kept else []
    inertia = [sum(d for d, n in found if n == c) for c in range(k)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia), digest[n]) for (i, _), (d, n) in zip(kept, found)), key=str)


def check(df):
    got = sorted(map(tuple, clusters.cluster_vectors(df).collect()), key=str)
    assert got == by_hand([(r.vec_id, r.embedding) for r in df.collect()])
    return got


def test_table_by_hand(spark):
    assert len(check(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(200))) == 200


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [[float(x) for x in np.float32(rng.normal(size=64))] for _ in range(30)]
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(0, good[0], 0), (None, good[1], 0), (7, good[2], 0), (40, None, 0), (41, [], 0), (42, good[0][:63], 0)]
    rows += [(43, [*good[0][:63], NAN], 0), (44, [*good[0][:63], INF], 0), (45, [*good[0][:63], None], 0), (46, [3e30] * 64, 0), (47, [-3e30] * 64, 0)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int").repartition(3))


def test_few_vectors_ties_and_none(spark):
    ones = [1.0] * 64
    kind = "vec_id long, embedding array<float>"
    assert {r[1] for r in check(spark.createDataFrame([(i, ones) for i in range(12)], kind))} == {0}
    check(spark.createDataFrame([(1, ones), (2, [0.5] * 64)], kind))
    check(spark.createDataFrame([], kind))


def test_abandoned_centroids_change_nothing():
    rng = np.random.default_rng(2)
    rows, centroids = rng.integers(-5, 5, (400, 64)), rng.integers(-5, 5, (9, 64))
    centroids[5] = centroids[2]
    all_of = ((rows[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    for order in (np.arange(64), rng.permutation(64)):
        which, far = clusters.nearest(rows, centroids, order)
        assert (which == all_of.argmin(axis=1)).all() and (far == all_of.min(axis=1)).all()
