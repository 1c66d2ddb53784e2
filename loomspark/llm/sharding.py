"""Shards of near-equal bytes in which equal texts stay together.

Longest-processing-time scheduling: groups of equal texts, largest first, go to the
least-loaded shard through a heap. Groups of one size are interchangeable, so the driver is told
how many groups there are of each size, and deals whole runs of them; which group of a
run goes where follows from its rank among those of its size. The loads are those of
dealing group by group. n bytes hold at most sqrt(2 n) different sizes: that bounds the driver's table.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import joined, staged

#: Rows that one window partition numbers, about.
ROWS_PER_CELL = 1 << 16


def lpt(sizes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, int]]:
    """(size, shard, after) from (size, number of groups), sizes falling.

    Of the groups of a size, ranked from 0, those below after and not below the after before it
    are the shard's. Of equal loads the shard of the smaller number is first.
    """
    heap = [(0, shard) for shard in range(n_shards)]
    out = []
    for size, count in sorted(sizes, reverse=True):
        dealt = [0] * n_shards
        left = count
        if count > 2 * n_shards:
            # every shard whose load is under the final level by a size or more is filled up to there at once
            low, n, filled = sorted(heap), 0, 0
            while n < n_shards and count * size + filled >= n * low[n][0]:
                filled += low[n][0]
                n += 1
            level = (count * size + filled) // n - size
            for load, shard in low[:n]:
                dealt[shard] = max(0, -(-(level - load) // size))
            left -= sum(dealt)
            heap = [(load + dealt[shard] * size, shard) for load, shard in heap]
            heapq.heapify(heap)
        for _ in range(left):
            load, shard = heap[0]
            dealt[shard] += 1
            heapq.heapreplace(heap, (load + size, shard))
        after = 0
        for shard, n in enumerate(dealt):
            if n:
                after += n
                out.append((size, shard, after))
    return out


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1; a null text counts as an empty one, and shares its
    group. Texts are told apart by their MD5. Null or repeated ids keep their rows: groups hang
    on the text alone. An empty table gives an empty result. Other columns of docs are not read.
    slot numbers a shard's rows from 0 without gaps; which row has which is not fixed.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = staged(
        docs.select(
            docs[id_col].alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("group"),
        )
    )
    n_rows = rows.count()
    n_cells = max(16, -(-n_rows // ROWS_PER_CELL))
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    groups = staged(groups.withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(n_cells))))
    per_cell = groups.groupBy("bytes", "cell").agg(F.count(F.lit(1)).alias("n"))
    counts = per_cell.groupBy("bytes").agg(F.sum("n").alias("n")).toArrow()  # at most sqrt(2 * all bytes) rows
    dealt = lpt(list(zip(counts.column("bytes").to_pylist(), counts.column("n").to_pylist(), strict=True)), n_shards)
    columns = zip(*dealt, strict=True) if dealt else ([], [], [])
    runs = staged(spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], ["bytes", "shard", "after"])))
    runs = runs.groupBy("bytes").agg(F.array_sort(F.collect_list(F.struct("after", "shard"))).alias("runs"))  # at most one for each shard
    start = F.coalesce(F.sum("n").over(Window.partitionBy("bytes").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = per_cell.withColumn("start", start).join(runs, "bytes").select("bytes", "cell", "start", "runs")
    rank = F.row_number().over(Window.partitionBy("bytes", "cell").orderBy("group")) - 1
    ranked = groups.withColumn("rank", rank).join(cells, ["bytes", "cell"])
    own = F.get(F.filter("runs", lambda run: run["after"] > F.col("start") + F.col("rank")), F.lit(0))
    placed = ranked.select("group", "n_rows", own["shard"].cast("int").alias("shard"))

    numbered = joined(rows.select("*", F.col("_metadata.row_index").alias("row")), placed, "group", "n_rows")
    # rows that are equal in all columns lie in different cells too
    cell = F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(n_cells))
    dealt_rows = staged(numbered.select("doc_id", "size", "text_crc32", "shard", cell.alias("cell")))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt_rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32")) - 1
    return dealt_rows.withColumn("place", place).join(starts, ["shard", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
