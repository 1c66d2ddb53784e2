import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import clustering as K


def plain(rows, k, rounds, dim, seed=2):
    """Assign by all distances, average, round down."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v):
            kept.append((i, [int(np.floor(256 * c)) for c in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [x for _, x in order[:k]]
    for t in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids] for _, x in kept]
        cluster = [f.index(min(f)) for f in far]
        if t < rounds:
            for j in range(len(centroids)):
                own = [x for (_, x), c in zip(kept, cluster) if c == j]
                if own:
                    centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    inertia = sum(min(f) for f in far)
    per = {j: sum(min(f) for f, c in zip(far, cluster) if c == j) for j in set(cluster)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, min(f), per[c], inertia, sha[c]) for (i, _), c, f in zip(kept, cluster, far)), key=str)


def run(spark, rows, kind="array<double>", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").withColumn("cluster", F.lit("mine")).repartition(3)
    out = K.clustered(df, **options)
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect()), key=str)


def test_clusters_are_those_of_all_distances(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) + 3 * rng.integers(0, 3, 8)).tolist()) for i in range(400)]
    assert run(spark, rows, k=12, rounds=5, dim=8) == plain(rows, 12, 5, 8)


def test_ties_repeats_and_unfit_vectors(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [-1.5, 0.25]), (None, None), (3, [1.0]), (4, [None, 1.0]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, [0.5, -0.0]), (8, []), (9, [1e-9, -1e-9])]
    for k in (1, 2, 4, 40):
        assert run(spark, rows, k=k, rounds=3, dim=2) == plain(rows, k, 3, 2)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * 150_000).tolist()) for i in range(60)]
    assert run(spark, rows, k=5, rounds=4, dim=3) == plain(rows, 5, 4, 3)
    assert run(spark, [(1, [6e5, 0.0, 0.0]), (2, [1.0, 2.0, 3.0])], k=5, rounds=1, dim=3) == plain([(2, [1.0, 2.0, 3.0])], 5, 1, 3)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


def test_bounds_save_distances_and_skip_nothing():
    """Bounds loosened by total displacement decide for most pairs, and whatever they skip was not nearer."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(size=(3000, 16)) + 6 * rng.integers(0, 4, (3000, 1)))).astype(np.int64)
    history = [x[:20].copy()]
    state = K.first_round(x, history[0])
    total = 0
    for t in range(1, 8):
        c = history[-1].copy()
        for j in range(20):
            if (state["cluster"] == j).any():
                c[j] = np.floor(x[state["cluster"] == j].mean(0))
        history.append(c)
        state = K.next_round(x, np.array(history), state["cluster"], state["bounds"], state["rounds"], t == 7)
        assert (state["cluster"] == K.squared(x, c).argmin(1)).all()
        total += state["measured"].sum()
    assert total < 0.5 * 7 * x.shape[0] * 20
    assert (state["distance"] == K.squared(x, history[-1]).min(1)).all()


def test_displacement_is_measured_over_all_rounds():
    """A centroid that went away and came back has not moved: its bound is as good as new."""
    x = np.array([[0, 0]])
    history = np.array([[[10, 0], [100, 0]], [[10, 0], [-400, 300]], [[10, 0], [100, 0]]])
    state = K.first_round(x, history[0])
    state = K.next_round(x, history, state["cluster"], state["bounds"], state["rounds"])
    assert state["measured"].tolist() == [0] and state["cluster"].tolist() == [0]


@pytest.mark.parametrize("dim", [64])
def test_query_shape(spark, dim):
    from loomspark.llm.queries import QUERIES

    out = QUERIES["op13_clustering"](spark, "/root/testdata/sf0.001")
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect()) == sorted(plain([(r.vec_id, r.embedding) for r in v.collect()], 40, 5, dim))
