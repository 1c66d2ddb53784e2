"""The registered queries of the analytics: operators over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parameters
from ..functions import text as X
from ..functions.rounding import round_exact
from ..functions.staging import deleted_at_exit, shared_dir, staged
from ..operators import diffstat as diff
from ..operators import decide, guard, history, judge, labels, replay, score, segment, suite
from . import adapters as A


def _us(ts: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))


def _as_of() -> Column:
    return F.lit(A.AS_OF).cast("timestamp_ntz")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.task_rows(A.messages(spark, sf_dir))


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.enriched(_tasks(spark, sf_dir), A.corrections(spark, sf_dir))


def segment_tasks(spark, sf_dir):
    t = _tasks(spark, sf_dir)
    return t.select("task_id", "session_id", "project", F.col("seg").cast("long").alias("seg"), _us("start_ts").alias("start_us"), _us("end_ts").alias("end_us"), "duration_sec", "prompt", F.col("prompt_chars").cast("long").alias("prompt_chars"), F.col("tool_calls").alias("tool_calls"), "output_tokens")


def _streamed(spark: SparkSession, changed: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """What a stream has made of all input, as its table stands; the table and the stream's state lie in the shared folder."""
    from ..streaming import changes

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    changes.keep(changed, f"{root}/table", f"{root}/state").awaitTermination()
    deleted_at_exit(spark, root)
    return changes.current(spark, f"{root}/table", keys, order)


def stream_tasks(spark, sf_dir):
    """segment_tasks as a stream of the events keeps it."""
    from ..streaming import segments

    t = _streamed(spark, segments.task_stream(A.messages(spark, sf_dir, A.event_stream(spark, sf_dir)), "10000 days"), ["session_id", "start_ord"], "version")
    us = lambda c: F.unix_micros(c)
    return t.select("task_id", "session_id", "project", "seg", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"), "duration_sec", "prompt", F.col("prompt_chars").cast("long").alias("prompt_chars"), "tool_calls", "output_tokens")


def stream_strategies(spark, sf_dir):
    """strategy_stats as a stream of the log keeps it."""
    from ..streaming import changes

    t = _streamed(spark, changes.strategy_changes(A.run_log(spark, sf_dir, A.event_stream(spark, sf_dir))), ["strategy"])
    return t.select("strategy", "tried", "kept", "lost", _us("last_tried").alias("last_tried_us"), _us("last_kept").alias("last_kept_us"), "success_rate", "recommendation")


def stream_baseline(spark, sf_dir):
    from ..streaming import changes

    return _streamed(spark, changes.baseline_changes(A.run_log(spark, sf_dir, A.event_stream(spark, sf_dir))), ["key"]).drop("key")


def task_tool_histogram(spark, sf_dir):
    return _tasks(spark, sf_dir).select("session_id", F.col("seg").cast("long").alias("seg"), X.shown_counts(F.col("tools")).alias("tools"))


def task_files_distinct(spark, sf_dir):
    return _tasks(spark, sf_dir).select("session_id", F.col("seg").cast("long").alias("seg"), F.size("files_changed").cast("long").alias("n_files"), F.array_join("files_changed", ",").alias("files"))


def last_nonzero_text(spark, sf_dir):
    return _tasks(spark, sf_dir).select("session_id", F.col("seg").cast("long").alias("seg"), "final_response_chars", _us("last_ts").alias("last_us"))


def segment_turns(spark, sf_dir):
    turns = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("turn").alias("ord"), (F.col("role") == "user").alias("is_prompt"), "text")
    return segment.segmented(turns).groupBy("session_id", "seg").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).cast("long").alias("n_chars")).select(F.col("session_id").alias("conv_id"), F.col("seg").cast("long").alias("seg"), "n_turns", "n_chars")


def classify_tasks(spark, sf_dir):
    return _enriched(spark, sf_dir).select("session_id", F.col("seg").cast("long").alias("seg"), "difficulty", "task_type", "outcome", "correction_logged")


def correction_interval_match(spark, sf_dir):
    return segment.corrected_tasks(_tasks(spark, sf_dir), A.corrections(spark, sf_dir)).select("session_id", F.col("seg").cast("long").alias("seg"))


def eligible_filter(spark, sf_dir):
    return _enriched(spark, sf_dir).filter(suite.is_eligible()).select("session_id", F.col("seg").cast("long").alias("seg"), suite.is_replayable().alias("replayable"))


def recency_age_days(spark, sf_dir):
    return suite.with_recency(_tasks(spark, sf_dir), _as_of()).select("session_id", F.col("seg").cast("long").alias("seg"), "age_days", "recency")


def _suite(spark, sf_dir):
    pool = suite.with_recency(_enriched(spark, sf_dir).filter(suite.is_eligible()), _as_of())
    return suite.stratified(pool)


def stratified_suite(spark, sf_dir):
    return _suite(spark, sf_dir).select("session_id", F.col("seg").cast("long").alias("seg"), F.col("pos").cast("long").alias("pos"), "recency", "task_type", "project", "duration_sec", "picked_by")


def suite_breakdown(spark, sf_dir):
    pool = suite.with_recency(_enriched(spark, sf_dir).filter(suite.is_eligible()), _as_of())
    return suite.breakdowns(pool)


def phrase_count(spark, sf_dir):
    return A.texts(spark, sf_dir).select("doc_id", X.phrase_count(F.col("text")).cast("long").alias("n_phrases"))


def options_count(spark, sf_dir):
    return A.texts(spark, sf_dir).select("doc_id", X.options_count(F.col("text")).cast("long").alias("n_options"))


def design_flag(spark, sf_dir):
    return A.texts(spark, sf_dir).select("doc_id", X.is_design(F.col("prompt")).alias("is_design"), X.search_first(F.col("prompt"), F.array(F.lit("Read"), F.lit("Bash")), F.col("text")).alias("search_first"))


def prompt_flags(spark, sf_dir):
    t = A.texts(spark, sf_dir).withColumn("wrapped", F.concat(F.when(F.col("doc_id") % 4 == 0, F.lit(" <system-reminder>")).otherwise(F.lit("  ")), "prompt"))
    return t.select("doc_id", X.is_prompt(F.col("wrapped")).alias("is_prompt"))


def cost_and_alignment(spark, sf_dir):
    o = A.table(spark, sf_dir, "lineitem")
    run, truth = (F.col("l_quantity").cast("long") % 12), F.col("l_linenumber").cast("long") - 1
    return o.groupBy(run.alias("run"), truth.alias("truth")).agg(F.count(F.lit(1)).alias("n")).select("run", "truth", "n", F.round(X.cost_ratio(F.col("run"), F.col("truth")), 4).alias("cost"), F.round(X.tool_alignment(F.col("run"), F.col("truth")), 4).alias("alignment"))


def sql_functions(spark, sf_dir):
    """The two ratios by functions of SQL, over the lines of orders."""
    parameters.register(spark)
    o = A.table(spark, sf_dir, "lineitem")
    pairs = o.select((F.col("l_quantity").cast("long") % 12).alias("run"), (F.col("l_linenumber").cast("long") - 1).alias("truth"))
    counted = pairs.groupBy("run", "truth").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("run", "truth", "n", F.expr("round(cost_ratio(run, truth), 4)").alias("cost"), F.expr("round(tool_alignment(run, truth), 4)").alias("alignment"))


def phrase_count_listed(spark, sf_dir):
    """phrase_count with its phrases joined in from a table."""
    return parameters.with_phrase_count(A.texts(spark, sf_dir).select("doc_id", "text"), parameters.default_lists(spark)["phrases"]).select("doc_id", "n_phrases")


def exact_rounding(spark, sf_dir):
    """Ratios that lie at or beside a half, rounded by their exact binary value."""
    x = (F.col("l_partkey") % 4000).cast("double") / 800 + F.col("l_linenumber") / 1000
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", round_exact(x, 2).alias("two"), round_exact(x / 3, 3).alias("three"), round_exact(x * -7, 1).alias("one"))


def _pairs(spark, sf_dir):
    t = _enriched(spark, sf_dir)
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))  # one row
    keyed = t.crossJoin(F.broadcast(n_docs)).withColumn("doc_id", F.col("start_ord") % F.col("n_docs"))
    k = F.col("start_ord")
    joined = keyed.join(docs, "doc_id").select(
        k.alias("benchmark_id"), "session_id", "seg", "prompt", F.col("tool_calls").alias("gt_tool_calls"), F.col("output_tokens").alias("gt_output_tokens"), suite.is_replayable().alias("replayable"),
        F.concat(F.col("text"), A.pick(A.SUFFIXES, k)).alias("response_text"), "calls",
        (F.col("tool_calls") * (k % 5) / 2).cast("long").alias("run_tool_calls"), F.floor(F.col("output_tokens") * (k % 7) / 4).cast("long").alias("run_output_tokens"),
        (k % 6 != 0).alias("completed_cleanly"), (k % 10 == 3).alias("correction_hook_fired"),
    )
    return joined.filter("replayable")


_PARTS = (*score.WEIGHTS, "cost")


def score_tasks(spark, sf_dir):
    return score.scored(_pairs(spark, sf_dir)).select("benchmark_id", *_PARTS, "score")


def score_run(spark, sf_dir):
    s = score.scored(_pairs(spark, sf_dir)).withColumn("run", F.col("benchmark_id") % 3)
    return score.run_summary(s, "run").select("run", "n_scored", "score_mean", "score_median", "score_stdev", *[f"mean_{c}" for c in _PARTS])


def _responses(spark, sf_dir):
    return A.table(spark, sf_dir, "events").filter("event_id % 3 <> 0").select(F.col("event_id").alias("benchmark_id"))


def missing_responses(spark, sf_dir):
    b = _enriched(spark, sf_dir).select(F.col("start_ord").alias("benchmark_id"), suite.is_replayable().alias("replayable"))
    return score.missing(b, _responses(spark, sf_dir))


def unknown_responses(spark, sf_dir):
    b = _enriched(spark, sf_dir).select(F.col("start_ord").alias("benchmark_id"))
    return score.unknown(b, _responses(spark, sf_dir))


def baseline_echo(spark, sf_dir):
    t = _enriched(spark, sf_dir).filter(suite.is_replayable())
    b = t.select(F.col("start_ord").alias("benchmark_id"), "prompt", F.col("tool_calls").alias("gt_tool_calls"), F.col("output_tokens").alias("gt_output_tokens"), "outcome", "correction_logged", "calls")
    r = score.echoed(b)
    return score.scored(b.drop("calls").join(r, "benchmark_id")).select("benchmark_id", *_PARTS, "score")


def prompt_normalize(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(X.normalize_prompt(F.col("html")).cast("binary")).alias("normalized_md5"))


def keyword_extract(spark, sf_dir):
    t = A.texts(spark, sf_dir).filter("prompt is not null").withColumn("kw", X.keywords(F.col("prompt")))
    return t.select("doc_id", F.size("kw").cast("long").alias("n_keywords"), F.md5(F.array_join(F.array_sort("kw"), " ").cast("binary")).alias("keywords_md5"))


def laplace_score(spark, sf_dir):
    """Documents as responses; what was wanted is a benchmark text, what was done another document's opening."""
    items = A.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("supposed_to"))
    n_items = items.agg(F.count(F.lit(1)).alias("n_items"))  # one row
    t = A.texts(spark, sf_dir).filter("length(text) > 0").crossJoin(F.broadcast(n_items)).withColumn("item_id", F.col("doc_id") % F.col("n_items"))
    t = t.join(items, "item_id").select("doc_id", F.col("text").alias("response_text"), "supposed_to", A.pick(A.SUFFIXES[1:], F.col("doc_id")).alias("what_i_did"))
    return labels.label_scores(t).select("doc_id", "label_score")


def _benchmark(spark, sf_dir):
    return A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("benchmark_id"), F.col("text").alias("prompt"))


def _label_corrections(spark, sf_dir):
    """documents as corrections; every seventh repeats a benchmark text in other white space."""
    d = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("prompt"))
    b = A.table(spark, sf_dir, "benchmark").filter("item_id % 7 = 0").select((F.col("item_id") + 10_000_000).alias("ord"), F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("   "))).alias("prompt"))
    return d.unionByName(b)


def label_exact(spark, sf_dir):
    return labels.exact(_benchmark(spark, sf_dir), _label_corrections(spark, sf_dir)).select("benchmark_id", "key_ord")


def label_contains(spark, sf_dir):
    return labels.contained(_benchmark(spark, sf_dir), _label_corrections(spark, sf_dir)).select("benchmark_id", "key_ord")


def label_union(spark, sf_dir):
    return labels.matched(_benchmark(spark, sf_dir), _label_corrections(spark, sf_dir)).select("benchmark_id", "key_ord", "how")


def resample_noise(spark, sf_dir):
    s = score.scored(_pairs(spark, sf_dir)).select("benchmark_id", "score")
    return score.resampled(s, 20, 0.7, 42)


def resample_components(spark, sf_dir):
    """The components of each replicate that resample_noise draws."""
    return score.replicate_means(score.scored(_pairs(spark, sf_dir)), 20, 0.7, 42)


def deadletter_pairs(spark, sf_dir):
    """Every pair given up, how often and by which run last."""
    return history.given_up(A.run_log(spark, sf_dir).filter("decision = 'user-reverted'"))


def _correction_scores(spark, sf_dir, pairs):
    return labels.correction_scores(pairs.select("benchmark_id", "prompt", "replayable"), A.task_corrections(spark, sf_dir), pairs)


def corrections_score(spark, sf_dir):
    """Replayed tasks whose prompt a correction matches, scored by it."""
    return _correction_scores(spark, sf_dir, staged(_pairs(spark, sf_dir)))


def experiment(spark, sf_dir):
    """Replayed tasks as twelve runs, each scored, judged, held against noise and corrections, and decided against the log's baseline."""
    pairs = staged(score.scored(_pairs(spark, sf_dir)).select("benchmark_id", "prompt", "replayable", "response_text", *_PARTS, "score").withColumn("run", F.col("benchmark_id") % 12))
    scores = score.run_summary(pairs, "run").select("run", "score_mean", (F.col("run") % 3 > 0).alias("auto"), (F.col("run") % 4 == 1).alias("skip_variance"), (F.col("run") % 6 == 0).alias("skip_judge"))
    judgments = judge.judge_summary(judge.judged(_answers(spark, sf_dir)).withColumn("run", F.col("benchmark_id") % 12).filter("run <> 7"), "run")
    noise = score.resampled(pairs, 20, 0.7, 42, keys=("run",)).filter("run <> 4")
    corrected = labels.composite(_correction_scores(spark, sf_dir, pairs).withColumn("run", F.col("benchmark_id") % 12), "run")
    out = decide.experiments(scores, judgments, noise, corrected, A.run_log(spark, sf_dir))
    return out.select("run", "score_mean", "baseline_run", "judge_composite", "noise_threshold", "n_matched", "corrections_composite", F.round("delta", 6).alias("delta"), "failed", "decision")


def baseline_seed(spark, sf_dir):
    """The log row of a first baseline: known outcomes scored as if they were responses."""
    return history.seed_row(score.run_summary(baseline_echo(spark, sf_dir)), "seed-0001", F.lit(A.AS_OF).cast("timestamp_ntz")).select("run_id", _us("ts").alias("ts_us"), "strategy", "decision", "score_mean", "score_median", "n_replayed")


def budget_prefix(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("ord"), F.floor("o_totalprice").cast("double").alias("cost"))
    return history.within_budget(o, 500_000.0, "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_run"), F.sum("cost").alias("spent"))


def budget_run(spark, sf_dir):
    """orders as calls of one run, in the order of their keys: those that a budget of a tenth of all costs reaches."""
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), "o_orderpriority", F.floor("o_totalprice").cast("double").alias("cost"))
    cap = o.agg(F.floor(F.sum("cost") / 10)).first()[0]
    return history.within_budget(o, cap).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_run"), F.sum("cost").alias("spent"), F.max("ord").alias("last_ord"))


def replay_counts(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderpriority").alias("run"), (F.col("o_orderkey") % 9 == 0).alias("timed_out"), (F.col("o_orderstatus") != "O").alias("completed"), (F.col("o_orderkey") % 4).alias("n_tool_calls"), F.floor("o_totalprice").cast("double").alias("cost"))
    return replay.replay_summary(runs, "run")


def _answers(spark, sf_dir):
    n = F.col("event_id")
    value = F.when(n % 11 == 0, "null").when(n % 13 == 0, '"x"').otherwise(((n % 14) / 2).cast("string"))
    body = F.concat(F.lit('{"position_taking": '), value, F.lit(', "task_completion": 4, "search_first": '), (n % 5 + 1).cast("string"), F.lit(', "tool_appropriate": 9, "response_specific": 2.5, "rationale": "r"}'))
    result = F.when(n % 17 == 0, "no judgment").when(n % 5 == 0, F.concat(F.lit("Here it is:\n  "), body, F.lit("  \nDone."))).when(n % 7 == 0, F.concat(F.lit("It is "), body, F.lit(" I think."))).otherwise(body)
    return A.table(spark, sf_dir, "events").select(n.alias("benchmark_id"), result.alias("result"), (F.floor("value") % 10 / 1000).alias("cost_usd"))


def judge_normalize(spark, sf_dir):
    from ..functions.config import DIMENSIONS

    j = judge.judged(_answers(spark, sf_dir))
    return j.select("benchmark_id", *[F.col(d).cast("long").alias(d) for d in DIMENSIONS], "judge_failed")


def judge_dims(spark, sf_dir):
    return judge.dimension_means(judge.judged(_answers(spark, sf_dir)))


def judge_totals(spark, sf_dir):
    return judge.judge_summary(judge.judged(_answers(spark, sf_dir)))


def judge_prompts(spark, sf_dir):
    d = A.texts(spark, sf_dir)
    p = judge.judge_prompt(F.col("prompt"), F.col("text"), F.create_map(F.lit("Read"), F.col("doc_id") % 3, F.lit("Bash"), F.col("doc_id") % 5))
    return d.select("doc_id", F.length(p).cast("long").alias("n_chars"), F.md5(p.cast("binary")).alias("prompt_md5"))


def baseline_latest(spark, sf_dir):
    return decide.latest_baseline(A.run_log(spark, sf_dir))


def decide_ladder(spark, sf_dir):
    n = F.col("event_id")
    runs = A.table(spark, sf_dir, "events").select(
        n.alias("run"),
        F.when(n % 19 != 0, 0.5 + (F.floor("value") % 50) / 100).alias("score_mean"),
        F.when(n % 6 != 0, 0.5 + (n % 40) / 100).alias("baseline_score"),
        F.when(n % 4 != 0, (n % 10) / 10).alias("judge_composite"),
        (n % 3).alias("judge_failed"),
        F.when(n % 5 != 0, (n % 8) / 100).alias("noise_threshold"),
        (n % 2).alias("n_matched"),
        (n % 7 / 10).alias("corrections_composite"),
        (n % 9 != 0).alias("auto"),
        (n % 8 == 0).alias("skip_variance"),
        (n % 10 >= 7).alias("skip_judge"),
        F.lit(False).alias("has_baseline"),
    )
    return decide.decided(runs).select("run", F.round("delta", 6).alias("delta"), "failed", "decision")


def _score_documents(spark, sf_dir):
    """events as runs with a folder (but one in eleven) and a document of scores, which takes another shape by number."""
    n = F.col("event_id")
    score = ((n % 100) / 100).cast("string")
    value = A.pick(("", "not json {", "{}", '{"score_mean": null}', '{"score_mean": "0.9"}', '{"score_mean": true}', "[1]"), n)
    value = F.when(n % 13 < 6, F.concat(F.lit('{"n_scored": 3, "score_mean": '), score, F.lit("}"))).otherwise(value)
    e = A.table(spark, sf_dir, "events")
    return e.select(n.alias("run"), (n % 11 != 0).alias("present")), e.filter(value != "").select(n.alias("run"), value.alias("value"))


def decide_inputs(spark, sf_dir):
    return decide.score_inputs(*_score_documents(spark, sf_dir))


def strategy_stats(spark, sf_dir):
    return history.strategy_stats(A.run_log(spark, sf_dir)).select("strategy", "tried", "kept", "lost", _us("last_tried").alias("last_tried_us"), _us("last_kept").alias("last_kept_us"), "success_rate", "recommendation")


def strategy_fill(spark, sf_dir):
    log = A.run_log(spark, sf_dir).filter("strategy in ('rule-rewrite', 'memory-add', 'user-approval')")
    return history.with_untried(history.strategy_stats(log))


def strategy_explore(spark, sf_dir):
    log = A.run_log(spark, sf_dir).filter("strategy in ('rule-rewrite', 'memory-add')")
    return history.explores(history.with_untried(history.strategy_stats(log)))


_SINCE = "2024-01-15 00:00:00"


def _week(spark, sf_dir):
    return history.real_runs(history.in_period(A.run_log(spark, sf_dir), F.lit(_SINCE).cast("timestamp_ntz")))


def weekly_decisions(spark, sf_dir):
    return history.decision_counts(_week(spark, sf_dir))


def weekly_trend(spark, sf_dir):
    return history.score_trend(_week(spark, sf_dir))


def weekly_strategies(spark, sf_dir):
    return history.period_strategies(_week(spark, sf_dir))


def strategy_table(spark, sf_dir):
    """Statistics of strategies as they are shown, best first."""
    return history.strategy_table(history.with_untried(history.strategy_stats(A.run_log(spark, sf_dir))))


def weekly_table(spark, sf_dir):
    return history.period_table(_week(spark, sf_dir))


def deadletter_block(spark, sf_dir):
    log = A.run_log(spark, sf_dir)
    return history.blocked(log.select("run_id", "strategy", "target_file"), log.filter("decision = 'user-reverted' and ord % 5 = 0"))


def recent_runs(spark, sf_dir):
    return A.run_log(spark, sf_dir).orderBy(F.desc("ord")).limit(5).select("run_id", "decision")


def three_strikes(spark, sf_dir):
    log = A.run_log(spark, sf_dir).withColumn("decision", F.when(F.col("score_mean") < 0.85, "sanity-floor-rejected").otherwise(F.col("decision")))
    return history.three_strikes(log).select("stream", "run_id")


def shared_root_cause(spark, sf_dir):
    return labels.shared_causes(labels.recent(A.corrections(spark, sf_dir)))


def _changes(spark, sf_dir):
    s = score.scored(_pairs(spark, sf_dir)).select("benchmark_id", "score")
    return history.score_changes(s, s.withColumn("score", F.round(F.col("score") * (F.col("benchmark_id") % 17 + 90) / 100, 4)))


def top_improvements(spark, sf_dir):
    return _changes(spark, sf_dir).orderBy(F.desc("change"), "benchmark_id").limit(3)


def top_regressions(spark, sf_dir):
    return _changes(spark, sf_dir).orderBy("change", "benchmark_id").limit(3)


def guard_paths(spark, sf_dir):
    path = guard.normalized(F.regexp_replace("url", r"^https?://[^/]+", ""))
    target = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/plugins/"), path)).when(F.col("page_id") % 5 == 1, F.lit("settings.json")).otherwise(path)
    t = guard.normalized(target)
    return A.table(spark, sf_dir, "pages").select("page_id", t.alias("target"), guard.is_forbidden(t).alias("forbidden"), guard.is_outside(t, ("en/", "memory/", "corrections.jsonl")).alias("outside"))


def guard_shrink(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    old = d.select(F.col("doc_id").alias("path"), "text")
    new = d.filter("doc_id % 6 <> 0").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 2 == 0, F.left("text", (F.length("text") / 3).cast("int"))).otherwise(F.col("text")).alias("text"))
    return guard.change_status(old, new).select("path", F.col("n_old").cast("long").alias("n_old"), F.col("n_new").cast("long").alias("n_new"), "status")


def json_extract_props(spark, sf_dir):
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return A.table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(v).alias("sum_k"), F.count(v).alias("n_k"), F.max(v).alias("max_k"))


def parse_model_output(spark, sf_dir):
    n = F.col("turn")
    escaped = F.to_json(F.struct(F.col("text").alias("result"), F.when(n % 3 == 0, "success").otherwise("error").alias("subtype"), F.struct((n * 10).alias("output_tokens")).alias("usage")))
    stdout = F.when((F.col("conv_id") + n) % 7 == 0, F.concat(F.lit("not json: "), F.left("text", F.lit(50)))).otherwise(escaped)
    outputs = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", stdout.alias("stdout"), (n % 4 == 3).cast("int").alias("returncode"), F.lit(False).alias("timed_out"))
    return replay.parsed(outputs).select("conv_id", "turn", F.md5(F.col("response_text").cast("binary")).alias("text_md5"), "output_tokens", F.size("calls").cast("long").alias("n_calls"), "completed_cleanly", "parse_error")


def project_totals(spark, sf_dir):
    return _tasks(spark, sf_dir).groupBy("project").agg(F.count(F.lit(1)).alias("n_tasks"), F.countDistinct("session_id").alias("n_sessions")).orderBy(F.desc("n_tasks"), "project").limit(10)


def find_run(spark, sf_dir):
    log = A.run_log(spark, sf_dir).withColumn("run_id", F.concat(F.lit("g"), (F.col("ord") % 1000).cast("string")))
    return history.disapproval_status(history.find_run(log, "g77")).select("run_id", "ord", "decision", "status")


def run_ids(spark, sf_dir):
    return A.table(spark, sf_dir, "events").groupBy(X.run_id(F.col("ts")).alias("run_id")).agg(F.count(F.lit(1)).alias("n"))


def suite_readiness(spark, sf_dir):
    return suite.readiness(_suite(spark, sf_dir).withColumn("replayable", suite.is_replayable()))


def proposals_listed(spark, sf_dir):
    return history.listed(A.run_log(spark, sf_dir).select("run_id", "strategy", "target_file"))


def _dead(spark, sf_dir):
    return A.run_log(spark, sf_dir).filter("decision = 'user-reverted' and ord % 5 = 0")


def status_row(spark, sf_dir):
    log = A.run_log(spark, sf_dir)
    return history.status(log, _dead(spark, sf_dir), A.reports(spark, sf_dir), "2024-01-20")


def report_banner(spark, sf_dir):
    """The latest daily report, if it is not among those that were read, and the last run of the log."""
    reports = A.reports(spark, sf_dir)
    log = A.run_log(spark, sf_dir).withColumn("delta", F.when(F.col("ord") % 4 != 0, (F.col("ord") % 64) / 64 - 0.5))
    return history.banner(reports, reports.filter("name < '2024-01-10'"), log)


def guidance_row(spark, sf_dir):
    log = A.run_log(spark, sf_dir).filter("strategy in ('rule-rewrite', 'memory-add', 'user-approval')")
    return history.guidance(history.with_untried(history.strategy_stats(log)))


def _feedback(spark, sf_dir):
    """events as actions of the user: sign-ups approve and errors reject proposals (one in nine has none), purchases take runs of the log back."""
    n = F.col("event_id")
    e = A.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "approve").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "purchase", "disapprove")
    run = F.concat(F.lit("run-"), n.cast("string"))
    actions = e.select(run.alias("run_id"), kind.alias("action"), F.col("props").alias("reason"), "ts", F.concat(F.lit("h"), n.cast("string")).alias("commit"), A.pick(("reset", "revert"), n).alias("revert_mode")).filter("action is not null")
    proposals = e.filter("event_id % 9 <> 0").select(
        run.alias("run_id"), F.when(n % 5 != 0, A.pick(A.STRATEGY_NAMES, F.col("user_id"))).alias("strategy"), F.concat(F.lit("m"), (n % 11).cast("string")).alias("target_file"),
        F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("summary "), n.cast("string"))).alias("change_summary"), ((n % 50) / 100).alias("score_mean"),
        F.concat(F.lit("b"), n.cast("string")).alias("baseline_commit"), F.concat(F.lit("proposed/"), n.cast("string"), F.lit(".md")).alias("path"),
    )
    log = A.run_log(spark, sf_dir).withColumns({"notes": F.when(F.col("ord") % 2 == 0, F.concat(F.lit("note "), F.col("ord").cast("string"))), "new_commit": F.when(F.col("ord") % 8 != 0, F.col("new_commit"))})
    return history.feedback_rows(actions, proposals, log, "LOOP")


def feedback(spark, sf_dir):
    """Every field of every row that the actions append."""
    tables = _feedback(spark, sf_dir)
    text = lambda *columns: F.concat_ws("|", *[F.coalesce(c, F.lit("~")) for c in columns]).alias("text")
    none = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    log = tables["experiment_log"].select(F.lit("experiment_log").alias("table"), "run_id", _us("ts").alias("ts_us"), "decision", "strategy", "target_file", F.col("baseline_commit").alias("commit_before"), F.col("new_commit").alias("commit_after"), F.col("baseline_score").alias("score_before"), F.col("score_mean").alias("score_after"), text("notes"))
    corrections = tables["corrections"].select(F.lit("corrections").alias("table"), none("run_id"), _us("ts").alias("ts_us"), none("decision"), none("strategy"), none("target_file"), none("commit_before"), none("commit_after"), none("score_before", "double"), none("score_after", "double"), text("project", "prompt", "what_i_did", "what_you_said", "supposed_to", "root_cause", "proposed_rule"))
    dead = tables["dead_letter"].select(F.lit("dead_letter").alias("table"), "run_id", _us("ts").alias("ts_us"), none("decision"), "strategy", "target_file", F.col("reverted_commit").alias("commit_before"), none("commit_after"), none("score_before", "double"), none("score_after", "double"), text("revert_mode", "reason"))
    return log.unionByName(corrections).unionByName(dead)


def feedback_refused(spark, sf_dir):
    """The actions that cannot be carried out, and why."""
    return _feedback(spark, sf_dir)["refused"]


def suite_entries(spark, sf_dir):
    e = suite.entries(_suite(spark, sf_dir))
    g = "ground_truth"
    return e.select("benchmark_id", "session_id", "prompt", "project", "task_type", "difficulty", "replayable", _us("first_message_at").alias("first_us"), F.col(f"{g}.tool_calls").alias("tool_calls"), X.shown_counts(F.col(f"{g}.tools")).alias("tools"), F.col(f"{g}.files_changed_count").cast("long").alias("n_files"), F.col(f"{g}.duration_sec").alias("duration_sec"), F.col(f"{g}.output_tokens").alias("output_tokens"), F.col(f"{g}.outcome").alias("outcome"), F.col(f"{g}.correction_logged").alias("correction_logged"))


def diffstat(spark, sf_dir):
    """Lines that each commit adds to and removes from each file."""
    return diff.diffstat(*A.versions(spark, sf_dir))


def weekly_kept(spark, sf_dir):
    """Kept runs of the period with the summary of their commit's changes, where it has any."""
    kept = _week(spark, sf_dir).filter(F.col("decision").isin("kept", "first-real-baseline"))
    diffs = diff.summaries(diff.diffstat(*A.versions(spark, sf_dir))).withColumnRenamed("commit", "new_commit")
    return kept.join(diffs, "new_commit", "left").select("run_id", "new_commit", "summary")


QUERIES = {
    f.__name__: f
    for f in (
        segment_tasks, stream_tasks, stream_strategies, stream_baseline, task_tool_histogram, task_files_distinct, last_nonzero_text, segment_turns, classify_tasks, correction_interval_match, eligible_filter,
        recency_age_days, stratified_suite, suite_breakdown, phrase_count, options_count, design_flag, prompt_flags, cost_and_alignment, sql_functions, phrase_count_listed, exact_rounding, score_tasks, score_run,
        missing_responses, unknown_responses, baseline_echo, prompt_normalize, keyword_extract, laplace_score, label_exact, label_contains, label_union,
        resample_noise, resample_components, corrections_score, experiment, baseline_seed, budget_prefix, budget_run, replay_counts, judge_normalize, judge_dims, judge_totals, judge_prompts, baseline_latest, decide_ladder, decide_inputs, strategy_stats,
        strategy_fill, strategy_explore, weekly_decisions, weekly_trend, weekly_strategies, strategy_table, weekly_table, deadletter_block, deadletter_pairs, recent_runs, three_strikes, shared_root_cause,
        top_improvements, top_regressions, guard_paths, guard_shrink, json_extract_props, parse_model_output, project_totals, find_run,
        run_ids, suite_readiness, proposals_listed, diffstat, weekly_kept, status_row, report_banner, guidance_row, feedback, feedback_refused, suite_entries,
    )
}
