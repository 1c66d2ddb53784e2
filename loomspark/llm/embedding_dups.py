"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are vectors of a bounded sample, each the farthest from those before
it; there are about as many as the square root of the number of vectors. Each vector is
described by its nearest pivots in order, and posted in the inverted list of each. Within a
list, vectors that share enough pivots are candidates; their cosine is verified in double
precision. A pair is counted in the list of its smallest shared pivot only, so nothing is
counted twice and no pair leaves its list: a list gives counts, and a forest of its links.
Vectors within a list lie in the order of their angle to the pivot: by the triangle inequality
only those whose angles differ by no more than that of the least cosine are compared.

Equal vectors are one class with a weight. Lists longer than BLOCK are dealt as pairs of
blocks, so no task holds more than two blocks whatever a list's length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joined, staged
from .components import components

#: Pivots at least and at most (in between the square root of the number of vectors), and vectors sampled for each.
MIN_PIVOTS, MAX_PIVOTS, SAMPLE = 32, 4096, 4
#: No pivot is as near as this to another one.
MAX_PIVOT_COSINE = 0.98
#: Nearest pivots of a vector, and how many of them two vectors must share.
NEAREST, SHARED = 8, 2
BLOCK = 1024


def unit(rows: list | np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision; large and small components do not overflow."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """The first vector of the sample, and then always the one whose nearest pivot is farthest away."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < most:
        at = int(near.argmin())
        if near[at] >= MAX_PIVOT_COSINE:
            break
        chosen.append(at)
        near = np.maximum(near, sample @ sample[at])
    return sample[chosen]


def described(x: np.ndarray, pivots: np.ndarray, k: int, reach: float | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each row the k nearest pivots, nearest first and ties by number, and the angles to them.

    With reach, all pivots whose angle is within twice reach of the nearest one's: then two rows
    whose angle is reach or less share one for certain.
    """
    angles = np.arccos(np.clip(x @ pivots.T, -1, 1))
    order = np.argsort(angles, axis=1, kind="stable")
    if reach is None:
        order = order[:, :k]
        return list(order), list(np.take_along_axis(angles, order, 1))
    sizes = (angles <= angles.min(1, keepdims=True) + 2 * reach + 1e-9).sum(1)
    return [o[:n] for o, n in zip(order, sizes, strict=True)], [a[o[:n]] for a, o, n in zip(angles, order, sizes, strict=True)]


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one dimension, none null, as rows."""
    return unit(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1))


def _posts(shared, k: int, reach: float | None):
    def post(batches):
        pivots = shared.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            found: list = [[]] * len(dims)
            angles: list = [[]] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, -(-len(at) // 1024)):
                    own, far = described(_matrix(batch.column("embedding").take(pa.array(part))), pivots[dim], k, reach)
                    for i, p, a in zip(part, own, far, strict=True):
                        found[i], angles[i] = p, a
            columns = {"pivots": pa.array(found, pa.list_(pa.int32())), "angles": pa.array(angles, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("key", "weight", "label", "dim")} | columns)

    return post


def _list_links(least: float, needed: dict[int, int]):
    """Counts and a forest of the links of one list, or of two blocks of it."""
    reach = math.acos(least) + 1e-9

    def links(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim, pivot, low, high = (table.column(c)[0].as_py() for c in ("dim", "pivot", "low", "high"))
        block, angle = (table.column(c).to_numpy() for c in ("block", "angle"))
        order = np.lexsort((angle, block))
        table, block, angle = table.take(pa.array(order)), block[order], angle[order]
        key, weight = (table.column(c).to_numpy() for c in ("key", "weight"))
        x = _matrix(table.column("embedding").combine_chunks())
        held = table.column("pivots").combine_chunks()
        names, columns = np.unique(held.flatten().to_numpy(), return_inverse=True)
        posted = np.zeros((len(key), len(names)), np.float32)
        posted[np.repeat(np.arange(len(key)), np.diff(held.offsets.to_numpy())), columns] = 1
        earlier = posted[:, : np.searchsorted(names, pivot)]
        cut = int(np.searchsorted(block, high)) if low < high else 0  # rows of the first block
        degree = np.zeros(len(key), np.int64)
        root = np.arange(len(key))
        edges: list[tuple[int, int]] = []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for start in range(0, cut or len(key), 256):
            end = min(start + 256, cut or len(key))
            # of the other rows, in order of their angles, those that can be near enough
            first = cut + int(np.searchsorted(angle[cut:], angle[start] - reach)) if cut else start
            last = cut + int(np.searchsorted(angle[cut:], angle[end - 1] + reach, side="right"))
            candidate = (posted[start:end] @ posted[first:last].T >= needed[dim]) & (earlier[start:end] @ earlier[first:last].T == 0)  # a smaller shared pivot has the pair
            if not cut:
                candidate &= np.arange(first, last)[None, :] > np.arange(start, end)[:, None]
            at, to = np.nonzero(candidate)
            at, to = at + start, to + first
            for part in range(0, len(at), 1 << 16):
                a, b = at[part : part + (1 << 16)], to[part : part + (1 << 16)]
                close = (x[a] * x[b]).sum(1) >= least
                a, b = a[close], b[close]
                np.add.at(degree, a, weight[b])
                np.add.at(degree, b, weight[a])
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    if (p := find(i)) != (q := find(j)):
                        root[max(p, q)] = min(p, q)
                        edges.append((i, j))
        some = np.flatnonzero(degree)
        a = np.concatenate([key[some], key[[e[0] for e in edges]]]) if edges else key[some]
        b = pa.array([None] * len(some) + [int(key[e[1]]) for e in edges], pa.int64())
        n = pa.array(degree[some].tolist() + [None] * len(edges), pa.int64())
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": n})

    return links


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, exact: bool = False) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine is least or more.
    Vectors that are null, empty, zero, or hold null or non-finite components, and those of
    other dimensions, link with nothing. Repeated rows are vectors like others and link with
    their copies; vectors are equal when 64-bit hashes of label and components are. component_id
    is the smallest id reachable by links, itself included; null ids never name a component
    that has another. Other columns are not read; an empty table gives an empty result.

    The index may miss links (tests measure recall); it makes none up. With exact it posts a
    vector with as many pivots as a link can need, and misses none; in many dimensions these
    are most of the pivots, so the work nears that of comparing all pairs.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    usable = (
        F.col("label").isNotNull()
        & x.isNotNull()
        & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists(x, lambda c: c != 0)
    )
    found = vectors.schema[vector_col].dataType
    kind = "array<float>" if isinstance(found, T.ArrayType) and isinstance(found.elementType, T.FloatType) else "array<double>"
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast(kind).alias("embedding"), vectors[label_col].cast("string").alias("label"))
    rows = rows.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "embedding")))
    keyed = staged(rows.select("vec_id", "key"))
    classes = staged(
        rows.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    )
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {dim: min(MAX_PIVOTS, max(MIN_PIVOTS, math.isqrt(n))) for dim, n in sizes.items()}
    by_dim: dict[int, list] = {}
    sampled = classes.select("dim", "embedding", F.xxhash64("key").alias("order")).orderBy("order").limit(SAMPLE * max(wanted.values(), default=0))
    for r in sampled.collect():  # a bounded sample
        by_dim.setdefault(r["dim"], []).append(r["embedding"])
    # a dimension too rare for the sample has one list
    pivots = {dim: choose_pivots(unit(by_dim[dim]), n) if dim in by_dim else unit(np.ones((1, dim))) for dim, n in wanted.items()}
    reach = math.acos(least) if exact else None
    posted = classes.mapInArrow(_posts(spark.sparkContext.broadcast(pivots), NEAREST, reach), "key long, weight long, label string, dim int, pivots array<int>, angles array<double>")
    posted = staged(posted)
    posts = posted.select("key", "weight", "label", "dim", "pivots", F.explode(F.arrays_zip(F.col("pivots").alias("pivot"), F.col("angles").alias("angle"))).alias("at")).select("*", "at.pivot", "at.angle").drop("at")
    lists = posts.groupBy("label", "dim", "pivot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("label", "dim", "pivot", F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blocks"))
    dealt = posts.join(lists, ["label", "dim", "pivot"]).withColumn("block", F.pmod(F.col("key"), F.col("n_blocks")).cast("int"))
    dealt = dealt.join(classes.select("key", "embedding"), "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "label", "dim", "pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "key", "weight", "block", "angle", "embedding", "pivots"
    )
    # where there are fewer pivots than two vectors must share, they share all
    needed = {dim: 1 if exact else min(SHARED, len(p)) for dim, p in pivots.items()}
    found = staged(dealt.groupBy("label", "dim", "pivot", "low", "high").applyInArrow(_list_links(least, needed), "a long, b long, n long"))
    degrees = found.filter("n is not null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null").select("a", "b")).select(F.col("node").alias("key"), "root")
    linked = staged(classes.select("key", "weight", "first_id").join(degrees, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    named = joined(linked, linked.groupBy("root").agg(F.min("first_id").alias("smallest"), F.count(F.lit(1)).alias("held")), "root", "held")
    by_key = staged(named.select("key", "weight", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), "smallest"))
    out = joined(keyed, by_key, "key", "weight")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
