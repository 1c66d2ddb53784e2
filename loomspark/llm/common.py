"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import BATCH_ROWS, deleted, let, shared_dir, staged

__all__ = ["BATCH_ROWS", "HEAVY", "deleted", "joined", "let", "read_table", "running", "shared_dir", "shuffle_parts", "staged"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key that holds at least this part of all rows is joined by broadcast: there are no more than that many.
HEAVY = 1 << 15


def joined(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows with the other columns of table, whose key is unique, or nulls; rows is read twice.

    weight says how many of the rows a key of table holds. Keys that hold 1/HEAVY of them or
    more are joined by broadcast and the others by a shuffle, so no task gets a hot key's rows.
    """
    n_rows = rows.count()
    heavy = F.col(weight) * HEAVY >= n_rows
    others = [c for c in table.columns if c not in (key, weight)]
    table = staged(table)
    marked = rows.join(F.broadcast(table.filter(heavy).select(key, *others, F.lit(True).alias("_loomspark_heavy"))), key, "left")
    hot = marked.filter("_loomspark_heavy").drop("_loomspark_heavy")
    rest = marked.filter("_loomspark_heavy is null").drop("_loomspark_heavy", *others).join(table.filter(~heavy).select(key, *others), key, "left")
    return hot.unionByName(rest)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """values joined from the first up to each place, by an associative join.

    In each round a place takes in what lies a power of two before it, so n values cost n log n
    steps; a fold that appends to an array would copy it n times.
    """
    rounds = F.filter(F.array(*[F.lit(1 << i) for i in range(31)]), lambda d: d < F.size(values))
    return F.aggregate(rounds, values, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, join(F.get(acc, i - d), x)).otherwise(x)))
