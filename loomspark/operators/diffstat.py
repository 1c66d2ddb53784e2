"""Lines added and removed between versions of files, by path and commit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines_of(text: str | None) -> list[str]:
    """Lines as version control counts them: what follows the last line end is a line if there is anything."""
    lines = (text or "").split("\n")
    return lines if lines[-1] else lines[:-1]


def kept_lines(old: list[str], new: list[str]) -> int:
    """Length of the longest run of lines that both have in the same order.

    Each line of new is matched with all its places in old at once, as bits of one number, so lines
    that come many times cost no more than others; what begins and ends alike is set aside first.
    """
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    old, new = old[head : len(old) - tail], new[head : len(new) - tail]
    places: dict[str, int] = {}
    for i, line in enumerate(old):
        places[line] = places.get(line, 0) | 1 << i
    every = (1 << len(old)) - 1
    free = every  # a cleared bit ends a longer run
    for line in new:
        if at := places.get(line, 0) & free:
            free = ((free + at) | (free - at)) & every
    return head + tail + len(old) - free.bit_count()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        added, removed = [], []
        for before, after in zip(batch.column("old"), batch.column("new"), strict=True):
            old, new = lines_of(before.as_py()), lines_of(after.as_py())
            same = kept_lines(old, new)
            added.append(len(new) - same)
            removed.append(len(old) - same)
        yield pa.RecordBatch.from_pydict({"commit": batch.column("commit"), "path": batch.column("path"), "change": batch.column("change"), "added": pa.array(added, pa.int64()), "removed": pa.array(removed, pa.int64())})


def changed_files(versions: DataFrame, commits: DataFrame) -> DataFrame:
    """commit, path, old, new and change (added, deleted, changed) of the files that differ from the commit's parent.

    versions has commit, path, text, and no row where a commit has no such file; commits has commit and parent (null of a first one).
    """
    new = versions.join(commits.select("commit").distinct(), "commit", "left_semi").select("commit", "path", F.col("text").alias("new"))
    old = versions.select(F.col("commit").alias("parent"), "path", F.col("text").alias("old")).join(commits.select("commit", "parent").distinct(), "parent").select("commit", "path", "old")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("changed")
    return old.join(new, ["commit", "path"], "full").filter(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", change)


def diffstat(versions: DataFrame, commits: DataFrame) -> DataFrame:
    """commit, path, change, added, removed (lines) for every file that a commit changes; null texts are absent files, and files of equal text are not listed."""
    changed = changed_files(versions, commits)
    kind = changed.schema["commit"].dataType.simpleString()
    return changed.select("commit", "path", "old", "new", "change").mapInArrow(_counts, f"commit {kind}, path string, change string, added long, removed long")


def summaries(stat: DataFrame) -> DataFrame:
    """commit and summary: a line for each file by path, and the totals. A commit without changed files has no row."""
    line = F.concat(F.col("path"), F.lit(" | "), (F.col("added") + F.col("removed")).cast("string"), F.lit(" +"), F.col("added").cast("string"), F.lit(" -"), F.col("removed").cast("string"))
    total = F.concat(F.count(F.lit(1)).cast("string"), F.lit(" changed, "), F.sum("added").cast("string"), F.lit(" added, "), F.sum("removed").cast("string"), F.lit(" removed"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"])  # the files of one commit
    return stat.groupBy("commit").agg(F.array_join(F.concat(listed, F.array(total)), "\n").alias("summary"))
