"""A stratified evaluation suite, drawn by windows and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import config as C
from ..functions import text as X

BUCKETS = ("recent", "mid", "older")


def is_eligible(s: C.Settings = C.DEFAULTS) -> Column:
    n = F.length("prompt")
    return (F.col("duration_sec") >= s.min_duration_sec) & n.between(s.min_prompt, s.max_prompt) & (F.col("outcome") != "no-op") & ~F.col("prompt").startswith("<")


def is_replayable() -> Column:
    return (F.col("tool_calls") > 0) & F.col("outcome").isin("completed", "corrected") & ~F.col("prompt").startswith("/")


def with_recency(tasks: DataFrame, as_of: Column, s: C.Settings = C.DEFAULTS) -> DataFrame:
    age = X.age_days(F.col("start_ts"), as_of)
    return tasks.withColumn("age_days", age).withColumn("recency", X.recency(F.col("age_days"), s))


def quotas(s: C.Settings = C.DEFAULTS) -> dict[str, int]:
    """Rows per recency bucket: at least one, half to even."""
    return {b: max(1, round(s.suite_size * w)) for b, w in zip(BUCKETS, s.recency_weights, strict=True)}


def stratified(tasks: DataFrame, s: C.Settings = C.DEFAULTS, key: str = "start_ord") -> DataFrame:
    """The suite: in each recency bucket, strata (type, project) take turns, longest tasks first.

    tasks has recency, task_type, project, duration_sec and key, a unique number. Short of the
    suite's size, leftovers in hash order fill it; beyond it, older buckets give way. pos is the
    place in the suite, picked_by quota or topup.
    """
    stratum = F.concat_ws("|", "recency", "task_type", "project")
    turn = Window.partitionBy("recency", "task_type", "project").orderBy(F.desc("duration_sec"), key)
    most = max(quotas(s).values())
    # of a stratum no more than the largest quota can be picked: a top-k before the buckets are ordered
    ranked = tasks.withColumn("turn", F.row_number().over(turn)).withColumn("_hash", X.hash_order(s.seed, stratum))
    in_bucket = Window.partitionBy("recency").orderBy("turn", "_hash", key)
    quota = F.create_map(*[x for b, n in quotas(s).items() for x in (F.lit(b), F.lit(n))])
    placed = ranked.filter(F.col("turn") <= most).withColumn("in_bucket", F.row_number().over(in_bucket))
    picked = placed.filter(F.col("in_bucket") <= F.element_at(quota, F.col("recency"))).withColumn("picked_by", F.lit("quota"))
    order = F.create_map(*[x for i, b in enumerate(BUCKETS) for x in (F.lit(b), F.lit(i))])
    left = tasks.join(picked.select(key), key, "left_anti").orderBy(X.hash_order(s.seed, F.col(key)), key).limit(s.suite_size)
    filler = left.withColumn("picked_by", F.lit("topup")).withColumn("in_bucket", F.row_number().over(Window.orderBy(X.hash_order(s.seed, F.col(key)), key)))
    both = picked.select(*tasks.columns, "in_bucket", "picked_by").unionByName(filler.select(*tasks.columns, "in_bucket", "picked_by"))
    # both sides are limited by the suite's size, so one window over all of them is small
    place = Window.orderBy(F.when(F.col("picked_by") == "topup", 9).otherwise(F.element_at(order, F.col("recency"))), "in_bucket")
    return both.withColumn("pos", F.row_number().over(place)).filter(F.col("pos") <= s.suite_size)


def entries(suite: DataFrame) -> DataFrame:
    """The suite's rows in their published shape, the known outcome nested."""
    truth = F.struct("tool_calls", "tools", F.size("files_changed").alias("files_changed_count"), "duration_sec", "output_tokens", "outcome", "correction_logged")
    return suite.select(
        F.col("task_id").alias("benchmark_id"), "prompt", "project", "task_type", "difficulty", truth.alias("ground_truth"), F.col("start_ts").alias("first_message_at"), "session_id", is_replayable().alias("replayable")
    )


def breakdowns(suite: DataFrame) -> DataFrame:
    """Counts by project, type, difficulty and recency in one pass: dimension, value, n, n_replayable."""
    suite = suite.withColumn("replayable", is_replayable().cast("int"))
    dims = ("project", "task_type", "difficulty", "recency")
    sets = [[d] for d in dims]
    grouped = suite.groupingSets([[F.col(x) for x in g] for g in sets], *[F.col(d) for d in dims]).agg(
        F.count(F.lit(1)).alias("n"), F.sum("replayable").cast("long").alias("n_replayable"), F.grouping_id().alias("_id")
    )
    bit = {d: 15 - (8 >> i) for i, d in enumerate(dims)}
    name = F.coalesce(*[F.when(F.col("_id") == b, F.lit(d)) for d, b in bit.items()])
    return grouped.select(name.alias("dimension"), F.coalesce(*[F.when(F.col("_id") == b, F.col(d)) for d, b in bit.items()]).alias("value"), "n", "n_replayable")


def readiness(suite: DataFrame, least: int = 6) -> DataFrame:
    """One row: how many entries are replayable, and whether those are enough for a run."""
    return suite.agg(F.count_if("replayable").alias("n_replayable")).withColumn("ready", F.col("n_replayable") >= least)
