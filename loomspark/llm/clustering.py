"""Exact centroid clustering with ns-bounds.

A vector keeps, for every centroid, the distance at which it last measured it and the round of
that measurement. All rounds' centroids are retained (rounds x k x dimension numbers), so a bound
of an earlier round is loosened by how far the centroid has moved in total since then, which by
the triangle inequality is no more than the sum of its moves and mostly less. A centroid whose
loosened lower bound exceeds the loosened distance to the vector's own centroid is not measured;
where bounds do not decide, the distance is measured in integers.

Components are integers, so distances, sums and means are exact and a result does not depend on
how rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import deleted, staged

#: Components are multiplied by this and rounded down.
SCALE = 256
#: Vectors with a component of this size or more are left out: the distance of two would not fit a long.
MOST = 1 << 19
#: Below this the products of components are exact in double precision.
EXACT = 1 << 22
#: Bounds are trusted beyond their own rounding only.
SLACK = 1e-9
STATE = "cluster int, previous int, distance long, measured long, bounds binary, rounds binary"


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64) -> DataFrame:
    """vec_id and x (integers floor(256 * component)) of the vectors with dim components, none null, non-finite or of 2^19 or more."""
    v = F.col("_v")
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("_v"))
    fit = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    return rows.filter(F.coalesce(fit, F.lit(False))).select("vec_id", F.transform(v, lambda c: F.floor(c * SCALE).cast("int")).alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c, exact."""
    small = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT
    x, c = (x.astype(np.float64), c.astype(np.float64)) if small else (x, c)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def first_round(x: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
    far = squared(x, c)
    cluster = far.argmin(1)
    return {
        "cluster": cluster, "previous": np.full(len(x), -1), "distance": far[np.arange(len(x)), cluster], "measured": np.full(len(x), len(c)),
        "bounds": np.sqrt(far.astype(np.float64)), "rounds": np.zeros(far.shape, np.uint8),
    }


def next_round(x: np.ndarray, history: np.ndarray, cluster: np.ndarray, bounds: np.ndarray, rounds: np.ndarray, last: bool = False) -> dict[str, np.ndarray]:
    """The state of one round from that of the round before; history holds the centroids of all rounds, this one's last.

    distance is that to the vector's centroid where it was measured in this round, in the last round always.
    """
    t, rows, own = len(history) - 1, np.arange(len(x)), cluster
    c = history[t].astype(np.int64)
    moved = np.sqrt(((history.astype(np.float64) - history[t].astype(np.float64)) ** 2).sum(2))  # of each centroid since each round
    loosened = bounds - moved[rounds, np.arange(len(c))[None, :]]
    bounds, rounds, measured, near = bounds.copy(), rounds.copy(), np.zeros(len(x), np.int64), np.full(len(x), -1)

    def undecided(at: np.ndarray, reach: np.ndarray) -> np.ndarray:
        out = loosened[at] <= reach[:, None] + SLACK * (1 + reach[:, None] + bounds[at])
        out[np.arange(len(at)), own[at]] = False
        return out

    def measure(at: np.ndarray, j: int) -> np.ndarray:
        far = squared(x[at], c[j : j + 1])[:, 0]
        bounds[at, j], rounds[at, j] = np.sqrt(far.astype(np.float64)), t
        measured[at] += 1
        return far

    tight = rows if last else np.flatnonzero(undecided(rows, bounds[rows, own] + moved[rounds[rows, own], own]).any(1))
    for j in np.unique(own[tight]):
        at = tight[own[tight] == j]
        near[at] = measure(at, j)
    failed = np.zeros(bounds.shape, bool)
    failed[tight] = undecided(tight, bounds[tight, own[tight]])
    best = cluster.copy()
    for j in np.flatnonzero(failed.any(0)):
        at = np.flatnonzero(failed[:, j])
        far = measure(at, j)
        better = (far < near[at]) | ((far == near[at]) & (j < best[at]))
        best[at[better]], near[at[better]] = j, far[better]
    return {"cluster": best, "previous": cluster, "distance": near, "measured": measured, "bounds": bounds, "rounds": rounds}


def _blocks(column: pa.Array, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _round(shared, t: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = shared.value
        for whole in batches:
            for start in range(0, len(whole), 2048):
                batch = whole.slice(start, 2048)
                n = len(batch)
                x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(n, -1)
                if t:
                    state = next_round(x, history, batch.column("cluster").to_numpy().astype(np.int64), _blocks(batch.column("bounds"), np.float64, n), _blocks(batch.column("rounds"), np.uint8, n), last)
                else:
                    state = first_round(x, history[0])
                columns = {"vec_id": batch.column("vec_id"), "x": batch.column("x")}
                columns |= {k: pa.array(state[k].astype(np.int32)) for k in ("cluster", "previous")} | {k: pa.array(state[k].astype(np.int64)) for k in ("distance", "measured")}
                columns |= {k: pa.array([r.tobytes() for r in state[k]], pa.binary()) for k in ("bounds", "rounds")}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`, in that order; equal ones by their components, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["x"] for r in rows.select(order.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()]


def _sums(state: DataFrame, dim: int) -> list:
    """For each centroid how many vectors it gained, and the sum of their components: of those that moved only."""
    parts = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("previous").alias("c"), F.lit(-1).alias("sign")))
    moved = state.filter("cluster <> previous").select("x", F.explode(parts).alias("p")).filter("p.c >= 0").select("x", "p.*")
    return moved.groupBy("c").agg(F.sum("sign").alias("n"), F.array(*[F.sum(F.col("x")[i].cast("long") * F.col("sign")) for i in range(dim)]).alias("total")).collect()  # k rows


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector that kept_vectors keeps: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, measured.

    k centroids (fewer if there are fewer vectors) start as the vectors that first_centroids
    names. Every round assigns each vector to its nearest centroid (squared Euclidean distance;
    ties: the smaller number) and makes each centroid the mean of its vectors, rounded down; an
    empty one stays. Then vectors are assigned once more. measured counts the distances that the
    last assignment evaluated for the vector.

    Vectors that are null, of another dimension or with null, non-finite or too large components
    have no row. Repeated rows, null ids and ids in several rows count as rows of their own. Other
    columns are not read; an empty table gives an empty result.
    """
    if rounds > 255:
        raise ValueError("a bound's round is kept in one byte")
    spark = vectors.sparkSession
    rows = staged(kept_vectors(vectors, id_col, vector_col, dim))
    history = [first_centroids(rows, k, seed)]
    n_of = np.zeros(k, object)
    total = np.zeros((k, dim), object)
    state = rows
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, x array<int>, {STATE}"
    for t in range(rounds + 1):
        if not history[0]:
            break
        shared = spark.sparkContext.broadcast(np.array(history, np.int64).reshape(t + 1, -1, dim))
        before, state = state, staged(state.mapInArrow(_round(shared, t, t == rounds), schema))
        deleted(before)
        if t < rounds:
            for r in _sums(state, dim):
                n_of[r["c"]] += r["n"]
                total[r["c"]] += np.array(r["total"], object)
            history.append([[s // n_of[j] for s in total[j]] if n_of[j] else c for j, c in enumerate(history[-1])])
    if not history[0]:
        return spark.createDataFrame([], T.StructType([rows.schema["vec_id"], *T._parse_datatype_string("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, measured long").fields]))
    shas = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(history[-1])]
    inertia = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("of"))
    per = inertia.join(F.broadcast(spark.createDataFrame(shas, "cluster int, centroid_sha256 string")), "cluster")
    whole = inertia.agg(F.sum("of").alias("all"))
    per = per.crossJoin(F.broadcast(whole))  # k rows and one
    fits = lambda c: F.expr(f"try_cast({c} as bigint)")
    return state.join(F.broadcast(per.select("cluster", fits("of").alias("cluster_inertia"), fits("all").alias("inertia"), "centroid_sha256")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured"
    )
