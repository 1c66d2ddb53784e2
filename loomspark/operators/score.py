"""Scores of responses against known tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.staging import staged

#: Weights of the components; the cost ratio is a diagnostic without weight.
WEIGHTS = {"completion": 1.5, "no_correction": 2.0, "no_premature": 1.5, "no_options": 1.5, "search_first": 1.0, "tool_alignment": 1.0}


def paired(benchmark: DataFrame, responses: DataFrame, key: str = "benchmark_id") -> DataFrame:
    """benchmark with each entry's response or nulls; replayable entries only."""
    return benchmark.filter("replayable").join(responses, key, "left")


def missing(benchmark: DataFrame, responses: DataFrame, key: str = "benchmark_id") -> DataFrame:
    return benchmark.filter("replayable").join(responses, key, "left_anti").select(key)


def unknown(benchmark: DataFrame, responses: DataFrame, key: str = "benchmark_id") -> DataFrame:
    return responses.join(benchmark, key, "left_anti").select(key)


def scored(pairs: DataFrame) -> DataFrame:
    """pairs with the six components, cost and score.

    pairs has prompt, gt_tool_calls, gt_output_tokens, and of the response: response_text, calls,
    run_tool_calls, run_output_tokens, completed_cleanly, correction_hook_fired.
    """
    text = F.coalesce("response_text", F.lit(""))
    out = pairs.withColumns({
        "completion": F.col("completed_cleanly").cast("double"),
        "no_correction": (~F.col("correction_hook_fired")).cast("double"),
        "no_premature": F.greatest(F.lit(0.0), 1 - 0.5 * X.phrase_count(text)),
        "no_options": (X.options_count(text) == 0).cast("double"),
        "search_first": X.search_first(F.col("prompt"), F.col("calls"), text).cast("double"),
        "tool_alignment": X.tool_alignment(F.col("run_tool_calls"), F.col("gt_tool_calls")),
        "cost": X.cost_ratio(F.col("run_output_tokens"), F.col("gt_output_tokens")),
    })
    total = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("score", F.round(total / sum(WEIGHTS.values()), 4))
    return out.withColumns({c: F.round(c, 3) for c in (*WEIGHTS, "cost")})


def run_summary(scores: DataFrame, *keys: str) -> DataFrame:
    """Mean, median and sample deviation over rounded task scores, and component means."""
    stats = [
        F.count(F.lit(1)).alias("n_scored"),
        F.round(F.avg("score"), 4).alias("score_mean"),
        F.round(F.median("score"), 4).alias("score_median"),
        F.round(F.stddev_samp("score"), 4).alias("score_stdev"),
    ]
    return scores.groupBy(*keys).agg(*stats, *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in (*WEIGHTS, "cost")])


def echoed(benchmark: DataFrame) -> DataFrame:
    """Responses that repeat the known outcome, for a first baseline.

    benchmark has benchmark_id, gt_tool_calls, gt_output_tokens, outcome, correction_logged, calls, and perhaps
    files_changed_count: then files_changed has as many nulls, for which files it were is not known.
    """
    counted = [F.array_repeat(F.lit(None).cast("string"), F.coalesce("files_changed_count", F.lit(0)).cast("int")).alias("files_changed")] if "files_changed_count" in benchmark.columns else []
    return benchmark.select(
        "benchmark_id",
        F.lit("(ground truth)").alias("response_text"),
        F.array_distinct("calls").alias("calls"),
        F.col("gt_tool_calls").alias("run_tool_calls"),
        F.col("gt_output_tokens").alias("run_output_tokens"),
        F.col("outcome").isin("completed", "corrected").alias("completed_cleanly"),
        F.col("correction_logged").alias("correction_hook_fired"),
        *counted,
    )


#: Leading hexadecimal digits of an order's hash that tell its range.
RANGE_DIGITS = 3


def _drawn(rows: DataFrame, replicates: int, fraction: float, seed: int, key: str, keys: tuple[str, ...]) -> DataFrame:
    """rows of each replicate (rep): the first max(3, n * fraction) of its own hash order; none of fewer than five rows.

    Which range of hashes holds a replicate's last row follows from the counts of the ranges, so
    only that range is sorted. These cuts are written, one row for each of keys, and the rows are copied
    for the replicates after they have met: of a join with the copies Spark knows the size of the rows
    only, and may send all copies through the driver. rows are read several times: stage them.
    """
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col("rep").cast("string"), F.lit("|"), F.col(key).cast("string")).cast("binary"))
    ranged = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("range", F.left(order, F.lit(RANGE_DIGITS)))
    counts = ranged.groupBy(*keys, "rep", "range").agg(F.count(F.lit(1)).alias("n"))
    replicate = Window.partitionBy(*keys, "rep")
    up_to = F.sum("n").over(replicate.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"before": up_to - F.col("n"), "all": F.sum("n").over(replicate)}).filter(F.col("all") >= 5)
    placed = placed.withColumn("size", F.greatest(F.lit(3), F.floor(F.col("all") * fraction)))
    # of each replicate one range: the one with its last task
    cut = placed.filter("before < size and before + n >= size").select(*keys, F.struct("rep", F.col("range").alias("cut"), (F.col("size") - F.col("before")).alias("left")).alias("c"))
    cuts = staged(cut.groupBy(*keys).agg(F.collect_list("c").alias("cuts")))
    met = rows.join(cuts, list(keys)) if keys else rows.crossJoin(F.broadcast(cuts))  # one row without keys
    copied = met.withColumn("c", F.explode("cuts")).select(*rows.columns, "c.rep", "c.cut", "c.left")
    marked = copied.withColumn("order", order).withColumn("range", F.left("order", F.lit(RANGE_DIGITS))).filter("range <= cut")
    last = marked.filter("range = cut").withColumn("place", F.row_number().over(replicate.orderBy("order", key))).filter(F.col("place") <= F.col("left"))
    kept = [c for c in rows.columns if c not in (*keys, key)]
    return marked.filter("range < cut").select(*keys, "rep", *kept).unionByName(last.select(*keys, "rep", *kept))


def resampled(scores: DataFrame, replicates: int, fraction: float, seed: int, noise_factor: float = 1.5, key: str = "benchmark_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """Spread of the mean score over subsamples without replacement, each drawn by hash order; one row, or one for each of keys.

    Tasks are scored once; replicates only draw from them. No row for fewer than five tasks or three replicates with a score.
    """
    taken = _drawn(staged(scores.select(*keys, key, "score")), replicates, fraction, seed, key, keys)
    means = taken.groupBy(*keys, "rep").agg(F.round(F.avg("score"), 4).alias("mean"))
    return means.groupBy(*keys).agg(
        F.count("mean").alias("n_valid"),
        F.round(F.avg("mean"), 4).alias("mean"),
        F.round(F.median("mean"), 4).alias("median"),
        F.round(F.stddev_samp("mean"), 4).alias("stdev"),
        F.min("mean").alias("min"),
        F.max("mean").alias("max"),
        F.round(F.stddev_samp("mean") * noise_factor, 4).alias("noise_threshold"),
    ).filter("n_valid >= 3")


def replicate_means(scores: DataFrame, replicates: int, fraction: float, seed: int, key: str = "benchmark_id", keys: tuple[str, ...] = (), components: tuple[str, ...] = (*WEIGHTS, "cost")) -> DataFrame:
    """One row per replicate that resampled draws: rep, n_tasks, mean (of the score) and mean_ of each component.

    Components have three places, as scored gives them; their means are rounded half up to four places in
    integers, so they do not depend on the order of the sums. Null components do not count; a component that is
    null in all of a replicate has a null mean. No row for fewer than five tasks.
    """
    taken = _drawn(staged(scores.select(*keys, key, "score", *components)), replicates, fraction, seed, key, keys)

    def mean(name: str):
        thousandths, n = F.sum(F.round(F.col(name) * 1000).cast("long")), F.count(name)
        return (F.floor((20 * thousandths + n) / F.nullif(2 * n, F.lit(0))) / 10000).alias(f"mean_{name}")

    return taken.groupBy(*keys, "rep").agg(F.count(F.lit(1)).alias("n_tasks"), F.round(F.avg("score"), 4).alias("mean"), *[mean(c) for c in components])
