"""History of runs: strategies, trends, dead letters, feedback and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import config as C
from ..functions.ordered import running


def real_runs(log: DataFrame) -> DataFrame:
    return log.filter(F.col("decision").isNull() | ~F.col("decision").isin(*C.NOT_RUNS))


def in_period(log: DataFrame, since: Column) -> DataFrame:
    return log.filter(F.col("ts") >= since)


def recommendation(tried: Column, rate: Column) -> Column:
    return (
        F.when(F.coalesce(tried, F.lit(0)) == 0, "untried").when((tried >= 5) & (rate < 0.10), "avoid").when((tried >= 3) & (rate >= 0.40), "promising").otherwise("neutral")
    )


def strategy_stats(log: DataFrame) -> DataFrame:
    """Per strategy: tried, kept, lost, success_rate, last_tried, last_kept, recommendation."""
    rows = log.filter((F.coalesce("strategy", F.lit("")) != "") & ~F.col("strategy").isin(*C.NOT_STRATEGIES))
    kept = F.col("decision").isin(*C.KEPT)
    out = rows.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("tried"),
        F.count_if(kept).alias("kept"),
        F.count_if(F.col("decision").isin(*C.LOST)).alias("lost"),
        F.max("ts").alias("last_tried"),
        F.max(F.when(kept, F.col("ts"))).alias("last_kept"),
    )
    rate = F.col("kept") / F.col("tried")
    return out.withColumn("success_rate", F.round(rate, 3)).withColumn("recommendation", recommendation(F.col("tried"), F.col("kept") / F.col("tried")))


def with_untried(stats: DataFrame) -> DataFrame:
    """All declared strategies and those that were tried, zeros where there is no run."""
    declared = stats.sparkSession.createDataFrame([(s,) for s in C.STRATEGIES], "strategy string")
    out = declared.join(stats, "strategy", "full")
    return out.select(
        "strategy",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tried", "kept", "lost")],
        F.coalesce("success_rate", F.lit(0.0)).alias("success_rate"),
        F.coalesce("recommendation", F.lit("untried")).alias("recommendation"),
    )


def explores(stats: DataFrame, least: int = 3) -> DataFrame:
    """Whether enough declared strategies are untried that one of them should be next."""
    return stats.filter(F.col("strategy").isin(*C.STRATEGIES)).agg(F.count_if(F.col("recommendation") == "untried").alias("n_untried")).withColumn("explore", F.col("n_untried") >= least)


def decision_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def score_trend(runs: DataFrame) -> DataFrame:
    """First, last, change and median of the runs with a score, by time."""
    at = F.struct("ts", "ord")
    out = runs.filter("score_mean is not null").agg(
        F.min_by("score_mean", at).alias("first_score"), F.max_by("score_mean", at).alias("last_score"), F.round(F.median("score_mean"), 4).alias("median_score"), F.count("score_mean").alias("n_scored")
    )
    return out.withColumn("delta", F.round(F.col("last_score") - F.col("first_score"), 4))


def period_strategies(runs: DataFrame) -> DataFrame:
    kept = F.count_if(F.col("decision").isin(*C.KEPT))
    return runs.filter("strategy is not null").groupBy("strategy").agg(F.count(F.lit(1)).alias("tried"), kept.alias("kept"), F.round(kept / F.count(F.lit(1)), 3).alias("rate"))


def strategy_table(stats: DataFrame) -> DataFrame:
    """Statistics in the order of the table that is shown: best rate first, then by name."""
    return stats.orderBy(F.desc("success_rate"), "strategy")


def period_table(runs: DataFrame, order: str = "ord") -> DataFrame:
    """period_strategies in the order of a report: best rate first, of equal ones the one that ran first."""
    first = runs.filter("strategy is not null").groupBy("strategy").agg(F.min(order).alias("_first"))
    kept = F.col("kept") / F.col("tried")
    return period_strategies(runs).join(first, "strategy").orderBy(F.desc(kept), "_first").drop("_first")


def blocked(proposals: DataFrame, dead: DataFrame) -> DataFrame:
    """Proposals whose (strategy, target_file) is a dead letter."""
    return proposals.join(dead.select("strategy", "target_file").distinct(), ["strategy", "target_file"], "left_semi")


def given_up(dead: DataFrame) -> DataFrame:
    """The pairs (strategy, target_file) of the dead letters, null ones too: n_rows, for a pair may repeat, and last_run, of the last row by ord."""
    return dead.groupBy("strategy", "target_file").agg(F.count(F.lit(1)).alias("n_rows"), F.max_by("run_id", "ord").alias("last_run"))


def three_strikes(log: DataFrame, label: str = "sanity-floor-rejected", key: str = "stream") -> DataFrame:
    """Rows at which the last three decisions of a stream all carry the label."""
    w = Window.partitionBy(key).orderBy("ord")
    flag = (F.col("decision") == label).cast("int")
    return log.withColumn("_all", F.min(flag).over(w.rowsBetween(-2, 0))).withColumn("_n", F.row_number().over(w)).filter("_all = 1 and _n >= 3").drop("_all", "_n")


def within_budget(rows: DataFrame, cap: float, *partition: str, cost: str = "cost", order: str = "ord") -> DataFrame:
    """Rows that are reached before the costs of those before them sum to the cap; without partition, over the whole run.

    order tells rows apart. Costs are summed in ranges of the order, so neither a run nor a partition of it is one task's work.
    """
    spent = {"spent_before": F.col(cost).cast("double")}
    return running(rows, list(partition), [F.col(order).asc()], spent, before=True).filter(F.col("spent_before") < cap)


def score_changes(before: DataFrame, after: DataFrame, key: str = "benchmark_id") -> DataFrame:
    return before.select(key, F.col("score").alias("before")).join(after.select(key, F.col("score").alias("after")), key).withColumn("change", F.round(F.col("after") - F.col("before"), 4))


def seed_row(summary: DataFrame, run_id: str, ts: Column) -> DataFrame:
    """The log row of a first baseline from the summary of its scores; no row if nothing was scored."""
    return summary.filter("n_scored > 0").select(
        F.lit(run_id).alias("run_id"), ts.alias("ts"), F.lit(C.NOT_STRATEGIES[0]).alias("strategy"), F.lit(None).cast("string").alias("target_file"), F.lit(C.NOT_RUNS[0]).alias("decision"),
        "score_mean", "score_median", F.lit(None).cast("double").alias("delta"), F.lit(None).cast("string").alias("new_commit"), F.col("n_scored").alias("n_replayed"),
    )


def find_run(log: DataFrame, run_id: Column | str) -> DataFrame:
    """The last row of a run."""
    wanted = F.lit(run_id) if isinstance(run_id, str) else run_id
    return log.filter(F.col("run_id") == wanted).agg(F.max_by(F.struct(*log.columns), "ord").alias("r")).filter("r is not null").select("r.*")


def disapproval_status(run: DataFrame) -> DataFrame:
    """Whether a run can be taken back: it was kept, by the loop and not by the user's approval, and names its commit."""
    status = F.when(~F.coalesce(F.col("decision").isin(*C.KEPT), F.lit(False)), "not-kept").when(F.coalesce("new_commit", F.lit("")) == "", "no-commit").otherwise("ok")
    return run.withColumn("status", status)


def feedback_status(actions: DataFrame, proposals: DataFrame, log: DataFrame) -> DataFrame:
    """actions (run_id, action, ...) with what they act on as `on`, and status: ok, no-proposal, not-found, not-kept or no-commit.

    An approval or rejection needs the run's proposal, a disapproval its last row in the log, kept and with a commit.
    """
    fields = ("strategy", "target_file", "change_summary", "score_mean", "baseline_commit", "path")
    proposed = proposals.groupBy("run_id").agg(F.first(F.struct(*[F.col(f) if f in proposals.columns else F.lit(None).cast("string").alias(f) for f in fields]), ignorenulls=True).alias("p"))
    runs = log.join(actions.filter("action = 'disapprove'").select("run_id").distinct(), "run_id", "left_semi")
    last = runs.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "run_id"]), "ord").alias("r"))
    kept = disapproval_status(last.select("run_id", "r.*")).select("run_id", F.col("status").alias("_kept"), F.struct("strategy", "target_file", "notes", "score_mean", "new_commit").alias("r"))
    found = actions.join(proposed, "run_id", "left").join(kept, "run_id", "left")
    back = F.col("action") == "disapprove"
    status = F.when(back, F.coalesce("_kept", F.lit("not-found"))).otherwise(F.when(F.col("p").isNull(), "no-proposal").otherwise("ok"))
    pick = lambda name, p, r: F.when(back, F.col(r) if r else None).otherwise(F.col(p) if p else None).alias(name)
    on = F.struct(
        pick("strategy", "p.strategy", "r.strategy"), pick("target_file", "p.target_file", "r.target_file"), pick("did", "p.change_summary", "r.notes"),
        pick("score", "p.score_mean", "r.score_mean"), pick("baseline", "p.baseline_commit", "r.new_commit"), pick("path", "p.path", None),
    )
    return found.withColumns({"on": on, "status": status}).drop("p", "r", "_kept")


def feedback_rows(actions: DataFrame, proposals: DataFrame, log: DataFrame, title: str = "RUN") -> dict[str, DataFrame]:
    """Rows that the user's actions append to each table, and `refused`: those that cannot be carried out, with their status.

    actions has run_id, action (approve, reject, disapprove), reason, ts, commit (the head after it) and revert_mode. A
    row of the log is named after the run and what was done to it, so that the run itself is still found by its own
    name. Approvals append to the log, the others also to corrections (which corrections_score can use) and dead letters.
    title is the loop's name: it begins a correction's prompt and, in small letters, its root cause.
    """
    checked = feedback_status(actions, proposals, log)
    ok = checked.filter("status = 'ok'")
    act = F.col("action")
    by = lambda a, r, d: F.when(act == "approve", a).when(act == "reject", r).otherwise(d)
    said = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    strategy, target, run, reason, mode = F.col("on.strategy"), F.col("on.target_file"), F.col("run_id"), said(F.col("reason")), said(F.col("revert_mode"))
    null = lambda kind: F.lit(None).cast(kind)
    # The wording of rows that later runs read.
    notes = by(
        F.concat(F.lit("Manually approved from proposal at "), said(F.col("on.path"))),
        F.concat(F.lit("Manually rejected from observation-mode proposal. reason="), reason),
        F.concat(F.lit("Disapproved by user. revert_mode="), mode, F.lit(". reason="), reason),
    )
    prompt = F.concat(F.lit(f"{title} "), run, F.lit(": "), said(strategy), F.lit(" on "), said(target))
    supposed = F.concat(F.lit("avoid this change; do not retry the same (strategy="), said(strategy), F.lit(", target="), said(target), F.lit(") pair"))
    pair = F.concat(F.lit("Dead-letter (strategy="), said(strategy), F.lit(", target_file="), said(target), F.lit("). "))
    rule = F.when(act == "reject", F.concat(pair, F.lit("The reason: "), reason)).otherwise(F.concat(pair, F.lit(f"Future /{title.lower()} runs MUST NOT propose the same pair. The reason the user vetoed: "), reason))
    refused = ok.filter("action <> 'approve'")
    return {
        "experiment_log": ok.select(
            F.concat(run, by(F.lit("-approved"), F.lit("-rejected"), F.lit("-disapproved"))).alias("run_id"), "ts", by(F.lit("user-approval"), F.lit("user-rejection"), F.lit("user-disapproval")).alias("strategy"), target.alias("target_file"),
            F.col("on.baseline").alias("baseline_commit"), F.when(act != "reject", F.col("commit")).alias("new_commit"), F.when(act == "disapprove", F.col("on.score")).alias("baseline_score"),
            F.when(act == "approve", F.col("on.score")).alias("score_mean"), null("double").alias("delta"), by(F.lit("user-approved"), F.lit("user-rejected"), F.lit("user-reverted")).alias("decision"),
            F.lit(0).cast("long").alias("n_replayed"), F.lit(0.0).alias("budget_used_usd"), notes.alias("notes"),
        ),
        "corrections": refused.select(
            "ts", F.lit("workspace").alias("project"), prompt.alias("prompt"), F.coalesce(F.nullif(F.col("on.did"), F.lit("")), strategy).alias("what_i_did"), F.col("reason").alias("what_you_said"), supposed.alias("supposed_to"),
            by(null("string"), F.lit(f"{title.lower()}-rejected-in-observation"), F.lit(f"{title.lower()}-disapproved")).alias("root_cause"), rule.alias("proposed_rule"),
        ),
        "dead_letter": refused.select(
            "run_id", strategy.alias("strategy"), target.alias("target_file"), F.when(act == "disapprove", F.col("on.baseline")).alias("reverted_commit"),
            F.when(act == "reject", "observation-rejected").otherwise(F.col("revert_mode")).alias("revert_mode"), "reason", "ts",
        ),
        "refused": checked.filter("status <> 'ok'").select("run_id", "action", "status"),
    }


def unread_report(reports: DataFrame, markers: DataFrame) -> DataFrame:
    """The latest report by name, unless it is weekly or marked as read."""
    latest = reports.filter(~F.col("name").startswith("weekly-")).agg(F.max("name").alias("name")).filter("name is not null")
    return latest.join(markers.select("name"), "name", "left_anti")


def listed(proposals: DataFrame, n: int = 20) -> DataFrame:
    """The first proposals by name."""
    return proposals.orderBy("run_id").limit(n)


def status(log: DataFrame, dead: DataFrame, reports: DataFrame | None = None, today: str = "", n: int = 5) -> DataFrame:
    """One row: last runs, number of (strategy, target_file) given up (of rows, where dead has neither), whether there is a report of today, baseline."""
    from .decide import latest_baseline

    last = log.orderBy(F.desc("ord")).limit(n).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "run_id", "decision")), asc=False), lambda x: F.concat(x["run_id"], F.lit(":"), x["decision"])), " ").alias("last_runs"))
    pair = [c for c in ("strategy", "target_file") if c in dead.columns]
    given_up = dead.agg((F.countDistinct(F.struct(*pair)) if pair else F.count(F.lit(1))).alias("n_dead"))
    reported = (reports if reports is not None else dead.sparkSession.createDataFrame([], "name string")).agg((F.count_if(F.col("name") == f"{today}.md") > 0).alias("reported_today"))
    return last.crossJoin(given_up).crossJoin(reported).join(latest_baseline(log), F.lit(True), "left")  # one row each


def banner(reports: DataFrame, markers: DataFrame, log: DataFrame) -> DataFrame:
    """The unread report with a line on the last run of the log; no row if there is none to read."""
    delta = F.when(F.col("r.delta").isNotNull(), F.format_string(" (%+.3f)", F.col("r.delta"))).otherwise("")
    last = log.agg(F.max_by(F.struct("run_id", "decision", "strategy", "delta"), "ord").alias("r"))
    line = F.concat(F.coalesce("r.run_id", F.lit("?")), F.lit(", "), F.coalesce("r.decision", F.lit("?")), F.lit(", "), F.coalesce("r.strategy", F.lit("?")), delta)
    return unread_report(reports, markers).crossJoin(F.broadcast(last)).select("name", F.when(F.col("r").isNotNull(), line).alias("last_run"))


def guidance(stats: DataFrame) -> DataFrame:
    """One row from statistics with the untried strategies: which are promising, untried and to be avoided, by name."""
    named = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("recommendation") == kind, F.col("strategy")))), ", ").alias(kind)
    return stats.agg(*[named(kind) for kind in ("promising", "untried", "avoid")])  # as many names as there are strategies


def weekly_report(log: DataFrame, since: Column, title: str = "Weekly report", diffs: DataFrame | None = None, dead: DataFrame | None = None, most: int = 1000, page: int = 0) -> str:
    """The report as markdown: counts, scores, strategies, kept changes, dead letters since then, and advice.

    A document is read by people: runs, changes and dead letters come in pages of `most` rows, the latest on page 0, and each
    list says how many pages it has. All pages together list all rows.
    """
    runs = real_runs(in_period(log, since))
    decisions = decision_counts(runs).orderBy(F.desc("n"), "decision").collect()
    n_runs = sum(r["n"] for r in decisions)
    lines = [f"# {title}", "", f"{n_runs} runs in the period.", ""]
    if not n_runs:
        return "\n".join(lines)

    def table(heading: str, head: tuple[str, ...], rows: list) -> None:
        if rows:
            lines.extend([f"## {heading}", "", "| " + " | ".join(head) + " |", "|---" * len(head) + "|", *["| " + " | ".join(map(str, r)) + " |" for r in rows], ""])

    def listed_rows(rows: DataFrame, *columns: str) -> tuple[int, list]:
        total = rows.count()
        order = [F.desc("ts"), *([F.desc("ord")] if "ord" in rows.columns else []), *sorted(set(columns) - {"ts", "ord"})]
        return total, rows.select(*dict.fromkeys((*columns, "ts", *(["ord"] if "ord" in rows.columns else [])))).orderBy(*order).offset(page * most).limit(most).collect()[::-1]

    def of_pages(total: int) -> str:
        return f"{total}, page {page + 1} of {-(-total // most)}" if total > most else str(total)

    table("Decisions taken", ("decision", "runs"), [(r["decision"], r["n"]) for r in decisions])
    trend = score_trend(runs).first()
    if trend["n_scored"]:
        _, scored = listed_rows(runs.filter("score_mean is not null").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day", "score_mean", "decision", "strategy")
        lines += [f"Scores went from {trend['first_score']:.4f} to {trend['last_score']:.4f} ({trend['delta']:+.4f}); their median is {trend['median_score']:.4f}.", ""]
        table("Scored runs", ("day", "score", "decision", "strategy"), [(r["day"], f"{r['score_mean']:.4f}", r["decision"], r["strategy"]) for r in scored])
    table("By strategy", ("strategy", "tried", "kept", "rate"), [(r["strategy"], r["tried"], r["kept"], f"{r['rate']:.0%}") for r in (period_table(runs) if "ord" in runs.columns else period_table(runs, "ts")).collect()])
    kept = runs.filter(F.col("decision").isin(*C.KEPT))
    kept = kept.join(diffs, "new_commit", "left") if diffs is not None else kept.withColumn("summary", F.lit(None).cast("string"))
    if "target_file" not in kept.columns:
        kept = kept.withColumn("target_file", F.lit(None).cast("string"))
    total, rows = listed_rows(kept, "run_id", "strategy", "target_file", "score_mean", "decision", "new_commit", "summary")
    if total:
        lines += [f"## Changes kept ({of_pages(total)})", ""]
        for r in rows:
            lines += [f"- `{r['run_id']}`: {r['strategy']} on {r['target_file']}, score {r['score_mean']}, {r['decision']}, commit `{(r['new_commit'] or '')[:8]}`", *([f"      {line}" for line in r["summary"].splitlines()] if r["summary"] else [])]
        lines.append("")
    if dead is not None:
        total, rows = listed_rows(in_period(dead, since), "strategy", "target_file")
        if total:
            lines += [f"## Given up ({of_pages(total)})", "", *[f"- {r['strategy']} on {r['target_file']}" for r in rows], ""]
    advice = with_untried(strategy_stats(log)).orderBy("strategy").collect()
    named = {k: ", ".join(r["strategy"] for r in advice if r["recommendation"] == k) for k in ("promising", "untried", "avoid")}
    said = [f"- {word}: {named[k]}" for k, word in (("promising", "Worth more tries"), ("untried", "Not tried yet"), ("avoid", "Better left alone")) if named[k]]
    return "\n".join([*lines, "## Next", "", *(said or ["- Too few runs to tell."])])
