"""Guards on what a change may touch."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import config as C


def normalized(path: Column, home: str = "") -> Column:
    """A path without its home prefix and leading slashes."""
    bare = F.regexp_replace(path, "^" + home.rstrip("/") + "/", "") if home else path
    return F.regexp_replace(bare, "^/+", "")


def is_forbidden(path: Column) -> Column:
    """The path starts with a forbidden prefix, or is that directory itself."""
    return reduce(or_, [path.startswith(p) | (path == p.rstrip("/")) for p in C.FORBIDDEN])


def is_outside(path: Column, allowed: tuple[str, ...]) -> Column:
    return ~reduce(or_, [path.startswith(p) for p in allowed])


def non_blank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\r\n|\r|\n"), lambda line: line.rlike(r"(?U)\S")))


def change_status(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """old with n_old, n_new and status of each file's change: safe, deleted, shrunk or halved."""
    pair = old.select(key, non_blank_lines(F.col("text")).alias("n_old")).join(new.select(key, non_blank_lines(F.col("text")).alias("n_new")), key, "left")
    status = (
        F.when(F.col("n_new").isNull(), "deleted")
        .when((F.col("n_old") >= 50) & (F.col("n_new") < 20), "shrunk")
        .when((F.col("n_old") > 0) & ((F.col("n_old") - F.col("n_new")) / F.col("n_old") > 0.5), "halved")
        .otherwise("safe")
    )
    return pair.withColumn("status", status)
