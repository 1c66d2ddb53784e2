"""Keep-or-revert decision of a run by five gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import config as C


def latest_baseline(log: DataFrame, order: str = "ord") -> DataFrame:
    """The last row of the log, in its own order, that was kept; no row if none was."""
    row = F.struct("run_id", "decision", "score_mean")
    last = log.filter(F.col("decision").isin(*C.KEPT)).agg(F.max_by(row, order).alias("b"))
    return last.filter("b is not null").select(F.col("b.run_id").alias("baseline_run"), F.col("b.score_mean").alias("baseline_score"))


def decided(runs: DataFrame, s: C.Settings = C.DEFAULTS) -> DataFrame:
    """runs with delta, failed (gate labels in order, comma-joined) and decision.

    runs has score_mean, baseline_score (null: none yet), judge_composite, judge_failed,
    noise_threshold, n_matched, corrections_composite, and booleans auto, skip_variance, skip_judge.
    A null score is an input error; without a baseline the gates do not decide. A baseline whose own
    score is null (has_baseline is true, baseline_score null) gives no delta, and fails the gates on it.
    """
    delta = F.col("score_mean") - F.col("baseline_score")

    def gate(fails: Column, label: str) -> Column:
        return F.when(F.coalesce(fails, F.lit(False)), F.lit(label))

    noise, judge = F.col("noise_threshold"), F.col("judge_composite")
    failed = F.array_compact(
        F.array(
            gate(F.coalesce(delta < s.delta_floor, F.lit(True)), "delta-floor"),
            gate(~F.col("skip_variance") & noise.isNull(), "variance-missing"),
            gate(~F.col("skip_variance") & noise.isNotNull() & F.coalesce(delta <= noise, F.col("has_baseline")), "variance"),
            gate(~F.col("skip_judge") & judge.isNull(), "judge-missing"),
            gate(~F.col("skip_judge") & (judge < s.judge_floor), "judge"),
            gate(~F.col("skip_judge") & (F.coalesce("judge_failed", F.lit(0)) >= s.max_judge_failures), "judge-completeness"),
            gate((F.coalesce("n_matched", F.lit(0)) > 0) & (F.col("corrections_composite") < s.corrections_floor), "corrections-aligned"),
        )
    )
    first_run = F.col("baseline_score").isNull() & ~F.coalesce(F.col("has_baseline"), F.lit(False))
    out = runs.withColumn("delta", delta).withColumn("_failed", failed)
    has = lambda *labels: F.arrays_overlap("_failed", F.array(*map(F.lit, labels)))
    only_delta = F.array_join("_failed", ",") == "delta-floor"
    kept = F.size("_failed") == 0
    auto = (
        F.when(kept, "kept")
        .when(only_delta & (F.col("delta") <= -s.delta_floor), "reverted")
        .when(only_delta, "delta-below-floor")
        .when(has("variance"), "noise-rejected")
        .when(has("judge", "judge-completeness"), "judge-rejected")
        .when(has("corrections-aligned"), "corrections-misaligned")
        .when(has("judge-missing", "variance-missing"), "gates-missing")
        .otherwise("gates-failed")
    )
    first = F.when(F.col("score_mean") < s.sanity_floor, "sanity-floor-rejected").when(F.col("auto"), "first-real-baseline").otherwise("proposed-first-real-baseline")
    decision = (
        F.when(F.col("score_mean").isNull(), "error")
        .when(first_run, first)
        .when(F.col("auto"), auto)
        .otherwise(F.when(kept, "proposed-kept").otherwise("proposed-reverted"))
    )
    return out.withColumn("failed", F.array_join("_failed", ",")).withColumn("decision", decision).drop("_failed")


def score_inputs(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """run, score_mean and reason (null where the score can be decided on) for every run of wanted.

    wanted has run and present, whether the run's folder is there; documents has run and value, the text of its scores. A run
    without a folder, without scores that can be read as an object, without the score, or with one that is no number (of no
    replayable task, say) has a reason and no score. true and false are the numbers 1 and 0.
    """
    v = F.try_parse_json("value")
    held = documents.groupBy("run").agg(F.max("value").alias("value")).select("run", v.alias("v"))
    score = F.try_variant_get("v", "$.score_mean", "variant")
    kind = F.schema_of_variant(score)
    number = F.when(kind == "BOOLEAN", F.try_variant_get("v", "$.score_mean", "boolean").cast("double")).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("v", "$.score_mean", "double"))
    keys = F.schema_of_variant("v")
    reason = (
        F.when(~F.coalesce("present", F.lit(False)), "run folder missing")
        .when(F.col("v").isNull() | ~F.coalesce(keys.startswith("OBJECT"), F.lit(False)), "scores missing")
        .when(score.isNull(), "scores without score_mean")
        .when(number.isNull(), F.concat(F.lit("score_mean is "), F.when(F.is_variant_null(score), "null").otherwise("no number"), F.lit(", likely of no replayable task")))
    )
    found = wanted.join(held, "run", "left")
    return found.select("run", F.when(reason.isNull(), number).alias("score_mean"), reason.alias("reason"))


def experiments(scores: DataFrame, judgments: DataFrame, noise: DataFrame, corrections: DataFrame, log: DataFrame, s: C.Settings = C.DEFAULTS) -> DataFrame:
    """The decision on every scored run, against the latest baseline of the log.

    scores has run, score_mean, auto, skip_variance, skip_judge; judgments run, judge_composite, n_failed; noise
    run, noise_threshold; corrections run, n_matched, corrections_composite. Of the last three a run may have no row.
    """
    row = F.struct("run_id", "score_mean")
    last = log.filter(F.col("decision").isin(*C.KEPT)).agg(F.max_by(row, "ord").alias("b"))  # one row, null without a baseline
    runs = (
        scores.join(judgments.select("run", "judge_composite", F.col("n_failed").alias("judge_failed")), "run", "left")
        .join(noise.select("run", "noise_threshold"), "run", "left")
        .join(corrections.select("run", "n_matched", "corrections_composite"), "run", "left")
        .crossJoin(F.broadcast(last))
        .withColumns({"baseline_run": F.col("b.run_id"), "baseline_score": F.col("b.score_mean"), "has_baseline": F.col("b").isNotNull()})
    )
    return decided(runs.drop("b"), s)
