"""Exact Jaccard join of word-shingle sets by PartEnum signatures.

Sets fall into bands by size. In a band the shingle domain is cut into cells by hash. Two sets
of n and m shingles that are similar enough differ in at most d = (n + m)(1 - s) / (1 + s)
shingles, so at most d cells differ. Take each set's non-empty cells in one common order: of
the first d + t of either, at least t are equal and lie in the other's first d + t as well.
A signature is a subset of t of them; similar sets share one. Small sets, whose cells hold
one shingle each, use pairs (t = 2). A set also signs in the band below if a partner can lie
there. Shingles that very many sets hold get cells of their own, last in the order, so a
common passage rarely makes a signature; which shingles those are changes the work only.

Sharing a signature makes candidates. First each set is held against the leader and the
neighbour of its signatures' groups, links are checked on whole sets, and linked sets form
components. Then only pairs across components are left; within a group they are screened by
a bound on their difference, and what remains is checked on whole sets again. So a large
group of near copies costs about its size, and no link between components is lost.

Sets are told apart by 64-bit hashes of their shingles and of themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, shuffle_parts, staged
from .components import components
from .shingles import mix, shingle_sets

#: Similarity of linked sets, in hundredths: a whole number, so that the test is exact.
SIMILARITY = 80
#: Sets under this size have single shingles as cells and pairs of cells as signatures.
SMALL = 64
SMALL_CELLS = 1 << 16
#: A shingle is common that this many sets of one task and of all tasks hold; this many are told apart at most.
COMMON_IN_TASK, COMMON_IN_ALL, MAX_COMMON = 2, 40, 1 << 18
COMMON_BITS = 24
#: Signatures of one group of the shuffle, about.
GROUP = 1 << 18
#: Members of a signature in a block, and rows of a task that compares them, about.
BLOCK, ROWS_PER_TASK = 2048, 1 << 15
#: Bits of the screen for the ids of candidates.
SCREEN_BITS = 20
_U = np.uint64


def band(size: int) -> int:
    return 0 if size < SMALL else (size // SMALL).bit_length()


def cells_of_band(level: int) -> int:
    """About 1.2 to 2.5 shingles a cell, so that a set has more non-empty cells than it can differ in."""
    return SMALL_CELLS if level == 0 else 51 << (level - 1)


def difference(total: int, similarity: int = SIMILARITY) -> int:
    """Most shingles that two similar sets of total shingles together can differ in."""
    return total * (100 - similarity) // (100 + similarity)


def bands_of(size: int, similarity: int = SIMILARITY) -> list[tuple[int, int]]:
    """Bands in which a set signs, each with the most it can differ in from a partner it meets there."""
    level, least, most = band(size), -(-size * similarity // 100), size * 100 // similarity
    out = [(level, difference(size + most, similarity))]
    for lower in range(band(least), level):
        top = SMALL * (1 << lower) - 1 if lower else SMALL - 1
        out.append((lower, difference(size + min(size, top), similarity)))
    return out


def _held(bits: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """1 for each shingle whose low bits are set in packed bits, 0 for others."""
    at = shingles & _U((1 << COMMON_BITS) - 1)
    return (bits[at >> _U(3)].astype(np.uint64) >> (_U(7) - (at & _U(7)))) & _U(1)


def signatures(shingles: np.ndarray, common: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Signatures of a set; common says by a shingle's low bits if very many sets hold it, a bit for each."""
    out = []
    for level, most in bands_of(len(shingles), similarity):
        if most == 0:
            continue  # similar means equal here, and equal sets are one
        n_cells = cells_of_band(level)
        cell = mix(shingles + _U(level + 1)) % _U(n_cells) + _held(common, shingles) * _U(n_cells)
        order = np.argsort(cell)
        cell = cell[order]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        held = np.add.reduceat(mix(shingles[order] ^ _U(0xA5A5A5A5)), first)
        subset = 2 if level == 0 else 1
        held = mix(held + cell[first] * _U(0x9E3779B97F4A7C15) + _U(level))[: most + subset]
        if subset == 2:
            i, j = np.triu_indices(len(held), 1)
            held = mix(held[i] * _U(3) + held[j])
        out.append(held)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles per hash bucket, packed. Two sets differ in no fewer shingles than their sketches in bits."""
    bits = 1024 << max(0, band(len(shingles)) - 3)
    counts = np.bincount((mix(shingles ^ _U(0x5BD1E995)) & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.uint64)


def folded(packed: np.ndarray, words: int) -> np.ndarray:
    """A sketch on fewer buckets: the halves of a sketch, one on the other."""
    while packed.shape[-1] > words:
        half = packed.shape[-1] // 2
        packed = packed[..., :half] ^ packed[..., half:]
    return packed


def similar(a: np.ndarray, b: np.ndarray, similarity: int = SIMILARITY) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= similarity * (len(a) + len(b) - shared)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[object, int, np.ndarray]]:
    """Id, class key and shingles of each row of (id, text)."""
    texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
    for doc, shingles in zip(batch.column(0).to_pylist(), shingle_sets(texts), strict=True):
        node = int((mix(shingles).sum() + _U(len(shingles))).astype(np.int64)) if len(shingles) else 0
        yield doc, node, shingles


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (id, n, node, sketch, -, -) per document, and rows (-, -, -, -, shingle, count) of a task's common shingles.

    Of the copies of a set that a task meets, the first alone has a sketch.
    """
    seen: set[int] = set()
    held: list[np.ndarray] = []
    common: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    size = 0

    def add() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        keep = counts >= COMMON_IN_TASK
        keys, counts = np.concatenate([common[0], keys[keep]]), np.concatenate([common[1], counts[keep]])
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)

    for batch in batches:
        docs, sizes, nodes, sketches = [], [], [], []
        for doc, node, shingles in _sets(batch):
            docs.append(doc)
            sizes.append(len(shingles))
            nodes.append(node)
            new = len(shingles) > 0 and node not in seen
            sketches.append(sketch(shingles).tobytes() if new else None)
            if new:
                seen.add(node)
                held.append(shingles)
                size += len(shingles)
            if size > 1 << 20:
                common, held, size = add(), [], 0
        yield _survey_rows(docs, sizes, nodes, sketches, [None] * len(docs), [None] * len(docs))
    if held:
        common = add()
    n = len(common[0])
    yield _survey_rows([None] * n, [None] * n, [None] * n, [None] * n, common[0].astype(np.int64).tolist(), common[1].tolist())


def _survey_rows(*columns: list) -> pa.RecordBatch:
    names = ["id", "n", "node", "sketch", "shingle", "held"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if name == "sketch" else pa.int64()) for c, name in zip(columns, names, strict=True)], names)


def _signer(common_bits, n_groups: int, similarity: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(common_bits.value, np.uint8)
        seen: set[int] = set()
        signs: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sign, node = np.concatenate(signs), np.concatenate(nodes)
            group = (sign >> _U(20)) % _U(n_groups)
            order = np.argsort(group, kind="stable")
            sign, node, group = sign[order], node[order], group[order]
            cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
            pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
            return pa.RecordBatch.from_pydict({
                "group": group[cuts[:-1]].astype(np.int64),
                "signs": pa.array([sign[a:b].tobytes() for a, b in pairs], pa.binary()),
                "nodes": pa.array([node[a:b].tobytes() for a, b in pairs], pa.binary()),
            })

        for batch in batches:
            for _, node, shingles in _sets(batch):
                if len(shingles) and node not in seen:
                    seen.add(node)
                    own = signatures(shingles, common, similarity)
                    if len(own):
                        signs.append(own)
                        nodes.append(np.full(len(own), node, np.int64))
                        size += len(own)
                if size > 1 << 18:
                    yield flush()
                    signs, nodes, size = [], [], 0
        if size:
            yield flush()

    return sign


def _shared(table: pa.Table) -> pa.Table:
    """Members (sign, node, n_members) of the signatures of one group that two sets or more share."""
    sign = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("signs")])
    node = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("nodes")])
    order = np.argsort(sign, kind="stable")
    sign, node = sign[order], node[order]
    first = np.append(True, sign[1:] != sign[:-1])
    many = ~first | np.append(~first[1:], False)
    sign, node = sign[many], node[many]
    order = np.lexsort((node, sign))
    sign, node = sign[order], node[order]
    new = np.append(True, (sign[1:] != sign[:-1]) | (node[1:] != node[:-1]))[: len(sign)]
    sign, node = sign[new], node[new]
    start = np.flatnonzero(np.append(True, sign[1:] != sign[:-1])[: len(sign)])
    size = np.diff(np.append(start, len(sign)))
    size = np.repeat(size, size)
    keep = size > 1
    return pa.table({"sign": sign[keep].astype(np.int64), "node": node[keep], "n_members": size[keep].astype(np.int64)})


def _wanted_sets(screen):
    """(node, shingles) of each set once a task, for ids that the screen lets through."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(screen.value, np.uint8)).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            keep = wanted[ids.fill_null(0).to_numpy(zero_copy_only=False) & ((1 << SCREEN_BITS) - 1)]
            nodes, sets = [], []
            for _, node, shingles in _sets(batch.filter(pa.array(keep | ids.is_null().to_numpy(zero_copy_only=False)))):
                if len(shingles) and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return sets


def _sets_of(nodes: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes, by another pass over the texts; a screen of bounded size spares most of them."""
    ids = classes.join(nodes, "node", "left_semi")
    screen = np.zeros(1 << SCREEN_BITS, bool)
    for r in ids.select(F.coalesce("first_id", F.lit(0)).bitwiseAND((1 << SCREEN_BITS) - 1).alias("bit")).distinct().collect():  # at most 2 ** SCREEN_BITS
        screen[r["bit"]] = True
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(screen).tobytes())
    found = texts.mapInArrow(_wanted_sets(shared), "node long, shingles binary")
    return staged(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]))


def _near(a: bytes, b: bytes, limit: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= limit


def _screened(similarity: int):
    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, m, n, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "sketch_a", "sketch_b"))
            keep = [min(m[i], n[i]) * 100 >= similarity * max(m[i], n[i]) and _near(x[i], y[i], difference(m[i] + n[i], similarity)) for i in range(len(a))]
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    return screen


def _exact(similarity: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True)]
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    return check


def _with_both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return pairs


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _across(similarity: int):
    """Pairs of different components within each list, from rows that are sorted by it; screened by sketches.

    A list is the members of a signature, or two blocks of them, of which only pairs across the blocks count.
    """

    def pairs_of(nodes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, sketches: list[bytes]) -> Iterator[tuple[int, int]]:
        packed = [np.frombuffer(s, np.uint64) for s in sketches]
        words = min(map(len, packed))
        packed = np.stack([folded(p, words) for p in packed])
        for i in range(len(nodes) - 1):
            rest = np.flatnonzero((roots[i + 1 :] != roots[i]) & ((blocks[i + 1 :] != blocks[i]) | (blocks[i] < 0))) + i + 1
            n = sizes[rest]
            rest = rest[np.minimum(n, sizes[i]) * 100 >= similarity * np.maximum(n, sizes[i])]
            if len(rest):
                differ = np.bitwise_count(packed[rest] ^ packed[i]).sum(1)
                for j in rest[differ <= (sizes[rest] + sizes[i]) * (100 - similarity) // (100 + similarity)]:
                    yield (int(nodes[i]), int(nodes[j])) if nodes[i] < nodes[j] else (int(nodes[j]), int(nodes[i]))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        told: set[tuple[int, int]] = set()

        def flush(table: pa.Table) -> pa.RecordBatch:
            sign = table.column("list").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, sign[1:] != sign[:-1])), len(sign))
            node, root, n, block = (table.column(c).to_numpy() for c in ("node", "root", "n", "block"))
            sketches = table.column("sketch").to_pylist()
            found = set()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                found.update(pairs_of(node[a:b], root[a:b], n[a:b], block[a:b], sketches[a:b]))
            found -= told
            if len(told) < 1 << 17:
                told.update(found)
            rows = list(zip(*found, strict=True)) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sign = batch.column("list").to_numpy()
            cut = int(np.searchsorted(sign, sign[-1]))  # rows before the last list are whole lists
            if cut or (held and held[-1].column("list")[-1].as_py() != sign[0]):
                yield flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield flush(pa.Table.from_batches(held))

    return across


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Documents link when their sets of word shingles have a Jaccard similarity of similarity
    hundredths or more; component_id is the smallest doc_id reachable by links, itself
    included. Texts that are null, empty or without words have no shingles and no links: their
    component is their own id. Repeated rows are copies like others. A null id never names a
    component, unless all of its documents have null ids. Other columns are not read; an empty
    table gives an empty result. similarity is from 70 to 100.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    survey = staged(texts.mapInArrow(_survey, "id long, n long, node long, sketch binary, shingle long, held long"))
    rows = survey.filter("node is not null").select("id", "n", "node", "sketch")
    # staged, or a semi join with it would be pushed below the aggregate, onto all copies of a set
    classes = staged(rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("held")))
    common = survey.filter("shingle is not null").groupBy("shingle").agg(F.sum("held").alias("held")).filter(F.col("held") >= COMMON_IN_ALL)
    bits = np.zeros(1 << COMMON_BITS, bool)
    for r in common.orderBy(F.desc("held"), "shingle").limit(MAX_COMMON).select("shingle").collect():
        bits[r["shingle"] & ((1 << COMMON_BITS) - 1)] = True
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_groups = max(64, -(-total // (2 * GROUP)))
    signed = texts.mapInArrow(_signer(spark.sparkContext.broadcast(np.packbits(bits).tobytes()), n_groups, similarity), "group long, signs binary, nodes binary")
    members = staged(signed.groupBy("group").applyInArrow(_shared, "sign long, node long, n_members long"))

    weights = members.groupBy("node").agg(F.sum("n_members").alias("weight"))
    sketches = staged(rows.filter("sketch is not null").join(weights, "node", "left_semi").select("node", "n", "sketch").dropDuplicates(["node"]))
    ranked = members.join(weights, "node").select("sign", "node", F.struct("weight", "node").alias("rank"))
    leaders = ranked.groupBy("sign").agg(F.max("rank").alias("top"))
    first = ranked.join(leaders, "sign").select(F.col("node").alias("x"), F.col("top.node").alias("y")).filter("x <> y")
    first = first.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    first = staged(_with_both(first, sketches, "n", "sketch").mapInArrow(_screened(similarity), "a long, b long"))
    sets = _sets_of(_ends(first), texts, classes)
    links = staged(_with_both(first, sets, "shingles").mapInArrow(_exact(similarity), "a long, b long"))
    roots = components(links)

    labelled = staged(members.join(roots, "node", "left").select("sign", "node", F.coalesce("root", "node").alias("root")))
    opened = labelled.groupBy("sign").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.count(F.lit(1)).alias("n_members")).filter("one <> other")
    opened = staged(opened.select("sign", "n_members", F.ceil(F.col("n_members") / BLOCK).alias("n_blocks")))
    n_dealt = opened.agg(F.coalesce(F.sum(F.col("n_members") * F.col("n_blocks")), F.lit(0))).first()[0]
    left = joined(labelled, opened, "sign", "n_members").filter("n_blocks is not null").join(sketches, "node")
    # one block: its pairs all count (block -1); more: every two of them make a list, and each one by itself
    own = F.pmod("node", "n_blocks")
    left = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    left = left.select(
        F.xxhash64("sign", F.least("own", "other"), F.greatest("own", "other")).alias("list"), F.when(F.col("own") == F.col("other"), F.lit(-1).cast("long")).otherwise(F.col("own")).alias("block"), "node", "root", "n", "sketch"
    )
    across = left.repartition(max(shuffle_parts(spark), -(-n_dealt // ROWS_PER_TASK)), "list").sortWithinPartitions("list").mapInArrow(_across(similarity), "a long, b long")
    across = staged(across.distinct())
    missing = staged(_ends(across).join(sets.select("node"), "node", "left_anti"))
    if not missing.isEmpty():
        sets = sets.unionByName(_sets_of(missing, texts, classes))
    more = staged(_with_both(across, sets, "shingles").mapInArrow(_exact(similarity), "a long, b long"))
    roots = components(links.unionByName(more))

    nodes = staged(classes.join(roots, "node", "left").select("node", "first_id", "held", F.coalesce("root", "node").alias("root")))
    smallest = nodes.groupBy("root").agg(F.min("first_id").alias("smallest"), F.count(F.lit(1)).alias("n_nodes"))
    named = joined(nodes, smallest, "root", "n_nodes").select("node", "smallest", "held")
    return joined(rows.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")), named, "node", "held").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("smallest", "id").alias("component_id")
    )
