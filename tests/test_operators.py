"""Operators on small hand-made inputs."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomspark.functions import config as C
from loomspark.functions import text as X
from loomspark.operators import decide, guard, history, judge, labels, replay, score, segment
from loomspark.sources import logs

MESSAGES = [
    ("user", "2026-01-01T10:00:00Z", "x" * 30 + " design-mode.", None),
    ("assistant", "2026-01-01T10:00:30Z", [{"type": "text", "text": "y" * 36}], 1200),
    ("assistant", "2026-01-01T10:01:00Z", [{"type": "tool_use", "name": "Bash", "input": {}}], 200),
    ("assistant", "2026-01-01T10:02:00Z", [{"type": "tool_use", "name": "Read", "input": {}}], 100),
    ("assistant", "2026-01-01T10:03:00Z", [{"type": "tool_use", "name": "Edit", "input": {"file_path": "/tmp/hook.sh"}}], 500),
    ("user", "2026-01-01T10:10:00Z", "z" * 49, None),
    ("assistant", "2026-01-01T10:11:00Z", [{"type": "text", "text": "w" * 45}], 1500),
    ("assistant", "2026-01-01T10:13:00Z", [{"type": "tool_use", "name": "Write", "input": {"file_path": "/tmp/notes.md"}}], 300),
]


@pytest.fixture
def sessions(spark, tmp_path):
    folder = tmp_path / "-home-test"
    folder.mkdir()
    rows = [json.dumps({"type": kind, "timestamp": ts, "message": {"content": content} | ({"usage": {"output_tokens": n}} if n else {})}) for kind, ts, content, n in MESSAGES]
    rows[1:1] = ["", "{broken", "[]", json.dumps({"type": "user", "timestamp": "2026-01-01T10:00:10Z", "message": {"content": "<system-reminder>no prompt"}})]
    (folder / "synthetic.jsonl").write_text("\n".join(rows))
    return logs.read_sessions(spark, str(tmp_path))


def tasks_of(sessions):
    return segment.task_rows(logs.messages(sessions, X.is_prompt, X.project_of(F.col("directory"), "test")))


def test_sessions_to_tasks(sessions):
    a, b = tasks_of(sessions).orderBy("seg").collect()
    assert (a.task_id, b.task_id) == ("syntheti-000", "syntheti-001")
    assert (a.duration_sec, b.duration_sec) == (600.0, 180.0)
    assert (a.tools, b.tools) == ({"Bash": 1, "Read": 1, "Edit": 1}, {"Write": 1})
    assert (a.files_changed, b.files_changed) == (["/tmp/hook.sh"], ["/tmp/notes.md"])
    assert (a.output_tokens, b.output_tokens) == (2000, 1800)
    assert (a.final_response_chars, b.final_response_chars) == (36, 45)
    assert (a.prompt_chars, b.prompt_chars) == (43, 49)
    assert a.calls == ["Bash", "Read", "Edit"]
    assert a.project == "workspace"


def test_enriched(spark, sessions):
    none = spark.createDataFrame([], "ts timestamp, project string")
    rows = segment.enriched(tasks_of(sessions), none).orderBy("seg").collect()
    assert [(r.difficulty, r.outcome, r.task_type, r.correction_logged) for r in rows] == [("long", "completed", "code-change", False), ("medium", "completed", "code-change", False)]
    one = spark.sql("select timestamp'2026-01-01 10:05:00' ts, 'WORKSPACE' project")
    assert [r.outcome for r in segment.enriched(tasks_of(sessions), one).orderBy("seg").collect()] == ["corrected", "completed"]


def test_long_session_numbers(spark):
    rows = spark.range(1002).select(F.lit("s").alias("session_id"), F.lit("p").alias("project"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("id").alias("ord"), F.lit(True).alias("is_prompt"), F.lit("hi").alias("prompt"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("file"), F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("text_chars"))
    assert segment.task_rows(rows).agg(F.max_by("task_id", "seg")).first()[0] == "s-1001"


@pytest.mark.parametrize(
    ("directory", "project"), [("-home-bob", "workspace"), ("-home-bob-myapp", "myapp"), ("-home-bob-code-foo", "code/foo"), ("-home-eve-x", "home-eve-x"), ("--", "unknown")]
)
def test_project(spark, directory, project):
    assert spark.range(1).select(X.project_of(F.lit(directory), "bob")).first()[0] == project


@pytest.mark.parametrize(("run", "want"), [(0, 0), (1, 0.5), (2, 1), (4, 1), (8, 1), (16, 0.5), (24, 0), (36, 0)])
def test_alignment(spark, run, want):
    assert spark.range(1).select(X.tool_alignment(F.lit(run), F.lit(4))).first()[0] == want


@pytest.mark.parametrize(("run", "want"), [(0, 0), (2, 1), (4, 1), (6, 0.5), (8, 0), (12, 0)])
def test_cost(spark, run, want):
    assert spark.range(1).select(X.cost_ratio(F.lit(run), F.lit(4))).first()[0] == want


@pytest.mark.parametrize(("text", "phrases", "options"), [("", 0, 0), ("TLDR: tldr: tldr:", 3, 0), ("Option A", 0, 1), ("would you like this\nor that", 0, 0), ("Here are two ways. Would you want x or path 2", 0, 3)])
def test_signals(spark, text, phrases, options):
    assert tuple(spark.range(1).select(X.phrase_count(F.lit(text)), X.options_count(F.lit(text))).first()) == (phrases, options)


@pytest.mark.parametrize(
    ("calls", "text", "want"), [(["WebSearch"], "", True), (["Read", "Bash"], "ran gh  search", True), (["Read", "Bash"], "", False), (["Edit"], "", False), (["Read"], "", False), ([], "", False)]
)
def test_search_first(spark, calls, text, want):
    df = spark.createDataFrame([("Please design it", calls, text)], "p string, c array<string>, t string")
    assert df.select(X.search_first(F.col("p"), F.col("c"), F.col("t"))).first()[0] is want


CASES = [  # auto, skip_judge, skip_variance, score, judge, judge_failed, noise, n_matched, composite, baseline, decision
    (True, False, False, 0.90, 0.75, 0, 0.01, 2, 0.7, 0.85, "kept"),
    (True, True, True, 0.80, None, None, None, None, None, 0.85, "reverted"),
    (True, True, True, 0.86, None, None, None, None, None, 0.85, "delta-below-floor"),
    (True, True, False, 0.88, None, None, 0.05, None, None, 0.85, "noise-rejected"),
    (True, False, True, 0.90, 0.4, 0, None, None, None, 0.85, "judge-rejected"),
    (True, False, True, 0.90, 0.75, 3, None, None, None, 0.85, "judge-rejected"),
    (True, False, False, 0.90, 0.75, 0, 0.01, 3, 0.2, 0.85, "corrections-misaligned"),
    (True, False, False, 0.90, 0.75, 0, 0.01, 0, 0.0, 0.85, "kept"),
    (False, True, True, 0.90, None, None, None, None, None, 0.85, "proposed-kept"),
    (False, True, True, 0.86, None, None, None, None, None, 0.85, "proposed-reverted"),
    (True, True, True, 0.7, None, None, None, None, None, None, "first-real-baseline"),
    (True, True, True, 0.3, None, None, None, None, None, None, "sanity-floor-rejected"),
    (True, True, True, None, None, None, None, None, None, 0.85, "error"),
    (True, True, False, 0.90, None, None, None, None, None, 0.85, "gates-missing"),
    (True, False, True, 0.90, None, None, None, None, None, 0.85, "gates-missing"),
    (True, True, False, 0.80, None, None, 0.01, None, None, 0.85, "noise-rejected"),
    (True, False, False, 0.90, 0.75, 0, 0.01, 2, 0.4, 0.85, "kept"),
    (True, True, True, 0.82, None, None, None, None, None, 0.80, "delta-below-floor"),
]


def test_decisions(spark):
    schema = "auto boolean, skip_judge boolean, skip_variance boolean, score_mean double, judge_composite double, judge_failed int, noise_threshold double, n_matched int, corrections_composite double, baseline_score double, want string, has_baseline boolean"
    rows = decide.decided(spark.createDataFrame([(*c, False) for c in CASES], schema)).collect()
    assert [r.decision for r in rows] == [r.want for r in rows]


@pytest.mark.parametrize(("tried", "kept", "want"), [(5, 0, "avoid"), (3, 2, "promising"), (2, 2, "neutral"), (10, 1, "neutral"), (0, 0, "untried")])
def test_recommendation(spark, tried, kept, want):
    assert spark.range(1).select(history.recommendation(F.lit(tried), F.try_divide(F.lit(kept), F.lit(tried)))).first()[0] == want


def test_empty_history(spark):
    log = spark.createDataFrame([], "run_id string, ts timestamp, ord long, strategy string, decision string, score_mean double, new_commit string")
    assert {r.recommendation for r in history.with_untried(history.strategy_stats(log)).collect()} == {"untried"}
    assert "0 runs in the period" in history.weekly_report(log, F.lit("2026-01-01").cast("timestamp"))


def test_weekly_report(spark):
    log = spark.sql("select 'r1' run_id, timestamp'2026-01-02' ts, 1L ord, 'memory-add' strategy, 'kept' decision, 0.8D score_mean, 'c1' new_commit union all select 'r2', timestamp'2026-01-03', 2, 'memory-add', 'reverted', 0.9, 'c2'")
    diffs = spark.createDataFrame([("c1", "a.md | 2 +-")], "new_commit string, summary string")
    dead = spark.sql("select 'rule-rewrite' strategy, 'b.md' target_file, timestamp'2026-01-03' ts union all select 'x', 'old.md', timestamp'2025-01-03'")
    text = history.weekly_report(log, F.lit("2026-01-01").cast("timestamp"), diffs=diffs, dead=dead)
    assert "2 runs in the period" in text and "from 0.8000 to 0.9000 (+0.1000)" in text and "| memory-add | 2 | 1 | 50% |" in text and "- `r1`: memory-add" in text
    assert "| 2026-01-02 | 0.8000 | kept | memory-add |" in text and "      a.md | 2 +-" in text and "- rule-rewrite on b.md" in text and "old.md" not in text


@pytest.mark.parametrize(("old", "new", "want"), [(60, 19, "shrunk"), (60, 31, "safe"), (60, 29, "halved"), (40, 19, "halved"), (5, None, "deleted"), (0, 0, "safe")])
def test_shrink(spark, old, new, want):
    o = spark.createDataFrame([("f", "a\n\n" * old)], "path string, text string")
    n = spark.createDataFrame([] if new is None else [("f", "a\n" * new)], "path string, text string")
    assert guard.change_status(o, n).first().status == want


@pytest.mark.parametrize(("path", "want"), [(".gitignore", True), ("plugins/foo", True), ("projects/anything", True), ("plugins", True), ("memory/x.md", False)])
def test_forbidden(spark, path, want):
    assert spark.range(1).select(guard.is_forbidden(F.lit(path))).first()[0] is want


@pytest.mark.parametrize(("text", "want"), [("", 0.5), ("nothing", 0.5), ("alpha beta2", 0.75), ("gamma", 0.3333), ("alpha gamma", 0.5)])
def test_label_score(spark, text, want):
    df = spark.createDataFrame([(text, "alpha beta2", "gamma")], "response_text string, supposed_to string, what_i_did string")
    assert labels.label_scores(df).first().label_score == want


def test_matching(spark):
    bench = spark.createDataFrame([("b1", "Fix  THE login"), ("b2", "please rename all of the modules now"), ("b3", "short one")], "benchmark_id string, prompt string")
    corr = spark.createDataFrame([(1, "fix the login", "old"), (2, "fix the   login", "new"), (3, "and please rename all of the modules now, thanks", "x"), (4, "rt one", "y")], "ord long, prompt string, root_cause string")
    rows = {r.benchmark_id: (r.key_ord, r.how) for r in labels.matched(bench, corr).collect()}
    assert rows == {"b1": (1, "exact"), "b2": (3, "contained")}
    assert labels.last_by_prompt(corr).filter("np = 'fix the login'").first().c.root_cause == "new"


def test_judge_json(spark):
    good = '{"position_taking": 2.5, "task_completion": 9, "search_first": 0, "tool_appropriate": null, "response_specific": "x"}'
    df = spark.createDataFrame([("a", f"Sure:\n  {good}  \n", 0.01), ("b", f"It is {good} indeed", 0.02), ("c", "no", 0.0), ("d", None, 0.0)], "benchmark_id string, result string, cost_usd double")
    rows = {r.benchmark_id: r for r in judge.judged(df).collect()}
    for k in "ab":
        assert (rows[k].position_taking, rows[k].task_completion, rows[k].search_first, rows[k].tool_appropriate, rows[k].response_specific, rows[k].judge_failed) == (2, 5, 1, None, None, False)
    assert rows["c"].judge_failed and rows["d"].judge_failed


def test_model_calls(spark):
    asked = judge.ask(spark.createDataFrame([("a", "p")], "benchmark_id string, judge_prompt string"), lambda text: (text * 2, 0.5)).first()
    assert (asked.result, asked.cost_usd) == ("pp", 0.5)


def test_model_output(spark):
    shape_b = json.dumps({"is_error": False, "usage": {"output_tokens": 7}, "messages": [{"role": "assistant", "content": [{"type": "tool_use", "name": "Bash"}, {"type": "text", "text": "one"}]}, {"role": "user", "content": "u"}, {"role": "assistant", "content": [{"type": "text", "text": "two"}, {"type": "tool_use"}]}]})
    shape_a = json.dumps({"subtype": "success", "result": "done"})
    df = spark.createDataFrame([("a", shape_a, 0, False), ("b", shape_b, 0, False), ("c", "oops", 0, False), ("d", shape_a, 1, False)], "benchmark_id string, stdout string, returncode int, timed_out boolean")
    rows = {r.benchmark_id: r for r in replay.parsed(df).collect()}
    assert (rows["a"].response_text, rows["a"].completed_cleanly) == ("done", True)
    assert (rows["b"].response_text, rows["b"].output_tokens, rows["b"].calls, rows["b"].completed_cleanly) == ("two", 7, ["Bash", "unknown"], True)
    assert (rows["c"].response_text, rows["c"].parse_error, rows["c"].completed_cleanly) == ("oops", True, False)
    assert rows["d"].completed_cleanly is False


def test_proposals(spark):
    fenced = '# P\n```json\n{"strategy": "memory-add", "target_file": "m.md", "score_mean": 0.5}\n```\n```diff\n+x\n```\n'
    bold = "**Strategy:** `rule-rewrite`\n**Target:** memory/a.md\n**Dry-run score:** 0.9878 → 0.99\n"
    rows = {r.run_id: r for r in logs.proposals(spark.createDataFrame([("a", fenced), ("b", bold), ("c", "none")], "run_id string, value string")).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"].strategy, rows["a"].score_mean, rows["a"].diff) == ("memory-add", 0.5, "+x")
    assert (rows["b"].strategy, rows["b"].target_file, rows["b"].score_mean, rows["b"].diff) == ("rule-rewrite", "memory/a.md", 0.9878, None)


def test_keyed_and_snapshots(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "b1.json").write_text('{"output_tokens": 5}')
    (tmp_path / "r" / "b2.json").write_text("{broken")
    assert [tuple(r) for r in logs.read_keyed(spark, str(tmp_path / "r"), "output_tokens long").collect()] == [("b1", 5)]
    for day, n in (("2026-01-01", 1), ("2026-01-02", 2)):
        logs.write_snapshot(spark.range(n), str(tmp_path / "s"), day)
    assert logs.read_latest(spark, str(tmp_path / "s")).count() == 2
    logs.append(spark.range(1), str(tmp_path / "a"))
    logs.append(spark.range(1), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2


def test_feedback(spark):
    """What is appended can be read again: by run, and by the scoring of corrections."""
    shape = "run_id string, action string, reason string, ts timestamp, commit string, revert_mode string"
    ts = datetime(2026, 1, 1)
    actions = spark.createDataFrame([("r1", "approve", "ok", ts, "h1", None), ("r2", "reject", "too long", ts, "h2", None), ("r3", "disapprove", "worse", ts, "h3", "reset"), ("r4", "disapprove", "x", ts, "h", None), ("r5", "reject", "x", ts, "h", None), ("r6", "disapprove", "x", ts, "h", None), ("r7", "disapprove", "x", ts, "h", None)], shape)
    proposals = spark.createDataFrame([("r1", "s", "t", "sum", 0.7, "b1", "p/r1.md"), ("r2", "s2", "t2", "", None, "b2", "p/r2.md")], "run_id string, strategy string, target_file string, change_summary string, score_mean double, baseline_commit string, path string")
    log = spark.createDataFrame([("r3", 1, "reverted", "s3", "t3", None, None, 0.1), ("r3", 2, "kept", "s3", "t3", "did it", "c3", 0.8), ("r4", 3, "user-approved", "s", "t", None, "c4", 0.8), ("r7", 4, "kept", "s", "t", None, None, 0.8)], "run_id string, ord long, decision string, strategy string, target_file string, notes string, new_commit string, score_mean double")
    rows = history.feedback_rows(actions, proposals, log, "LOOP")
    assert sorted(tuple(r) for r in rows["refused"].collect()) == [("r4", "disapprove", "not-kept"), ("r5", "reject", "no-proposal"), ("r6", "disapprove", "not-found"), ("r7", "disapprove", "no-commit")]
    by = {r.run_id: r for r in rows["experiment_log"].collect()}
    assert set(by) == {"r1-approved", "r2-rejected", "r3-disapproved"}
    a, d = by["r1-approved"], by["r3-disapproved"]
    assert (a.score_mean, a.baseline_commit, a.new_commit, a.decision, a.notes) == (0.7, "b1", "h1", "user-approved", "Manually approved from proposal at p/r1.md")
    assert (d.baseline_score, d.baseline_commit, d.new_commit, d.score_mean, d.strategy) == (0.8, "c3", "h3", None, "user-disapproval")
    assert by["r2-rejected"].new_commit is None
    c = {r.root_cause: r for r in rows["corrections"].collect()}
    assert c["loop-disapproved"].prompt == "LOOP r3: s3 on t3" and c["loop-disapproved"].what_i_did == "did it"
    assert c["loop-rejected-in-observation"].what_i_did == "s2" and c["loop-rejected-in-observation"].proposed_rule.endswith("The reason: too long")
    dead = {r.run_id: (r.strategy, r.reverted_commit, r.revert_mode) for r in rows["dead_letter"].collect()}
    assert dead == {"r2": ("s2", None, "observation-rejected"), "r3": ("s3", "c3", "reset")}
    whole = log.unionByName(rows["experiment_log"].withColumn("ord", F.lit(9).cast("long")), allowMissingColumns=True)
    assert history.find_run(whole, "r3").first().decision == "kept"  # the run itself, not what was said of it
    scores = labels.correction_scores(spark.createDataFrame([("b", "loop R3:  s3 on t3", True)], "benchmark_id string, prompt string, replayable boolean"), rows["corrections"].withColumn("ord", F.monotonically_increasing_id()), spark.createDataFrame([("b", "avoid this change")], "benchmark_id string, response_text string"))
    assert scores.count() == 1


def test_surface(spark):
    reports = spark.createDataFrame([("2026-01-01.md",), ("2026-01-02.md",), ("weekly-2026-01-03.md",)], "name string")
    none = spark.createDataFrame([], "name string")
    assert history.unread_report(reports, none).first().name == "2026-01-02.md"
    assert history.unread_report(reports, reports).count() == 0


def test_status(spark):
    log = spark.sql("select 'r1' run_id, 'kept' decision, 0.8D score_mean, 1L ord union all select 'r2', 'reverted', 0.7, 2")
    row = history.status(log, spark.range(3)).first()
    assert (row.last_runs, row.n_dead, row.baseline_run) == ("r2:reverted r1:kept", 3, "r1")


def test_score_of_nothing(spark):
    empty = spark.createDataFrame([], "benchmark_id string, score double, completion double, no_correction double, no_premature double, no_options double, search_first double, tool_alignment double, cost double")
    assert score.run_summary(empty).first().score_mean is None
    assert score.resampled(empty, 20, 0.7, 42).count() == 0


def test_containment_is_that_of_all_pairs(spark):
    import random

    rng = random.Random(1)
    words = ["a", "an", "ant", "bee", "b", "cat", "cats", "the", "one"]
    text = lambda low, high: " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))
    for least in (1, 6):
        bench = [(i, text(0, 9)) for i in range(60)] + [(60, "the cat"), (61, ""), (62, None), (63, "ee")]
        corr = [(100 + i, text(0, 12), "x") for i in range(60)] + [(90, "ant", "x"), (91, "be", "x"), (92, "", "x")]
        b = spark.createDataFrame(bench, "benchmark_id long, prompt string")
        c = spark.createDataFrame(corr, "ord long, prompt string, root_cause string")
        first = {}
        for k, t, _ in corr:
            if t and len(t) >= least:
                first.setdefault(t, k)
        want = {}
        for i, t in bench:
            hits = [k for p, k in first.items() if p in (t or "") or (t or "") in p]
            if hits:
                want[i] = min(hits)
        assert {r.benchmark_id: r.key_ord for r in labels.contained(b, c, least).collect()} == want
    assert labels.contained(b.limit(0), c).count() == labels.contained(b, c.limit(0)).count() == 0


def test_resampling_takes_the_first_by_hash(spark):
    import hashlib
    import statistics

    rows = [(i, (i * 37 % 101) / 100, i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "benchmark_id long, score double, run long")

    def means(own):
        size = max(3, int(len(own) * 0.7))
        return [round(statistics.mean(s for _, s in sorted(own, key=lambda x: (hashlib.md5(f"7|{rep}|{x[0]}".encode()).hexdigest(), x[0]))[:size]), 4) for rep in range(5)]

    one = score.resampled(df, 5, 0.7, 7).first()
    assert abs(one.stdev - statistics.stdev(means([(i, s) for i, s, _ in rows]))) < 1e-4 and one.n_valid == 5
    by_run = {r.run: r for r in score.resampled(df, 5, 0.7, 7, keys=("run",)).collect()}
    for run in range(3):
        own = means([(i, s) for i, s, r in rows if r == run])
        assert abs(by_run[run].stdev - statistics.stdev(own)) < 1e-4 and abs(by_run[run]["min"] - min(own)) < 1e-4
    assert score.resampled(df.limit(4), 5, 0.7, 7).count() == 0


def test_component_means_of_replicates(spark):
    import hashlib
    from fractions import Fraction

    rows = [(i, round((i * 37 % 101) / 101, 4), round((i * 53 % 97) / 97, 3) if i % 7 else None, None) for i in range(40)]
    df = spark.createDataFrame(rows, "benchmark_id long, score double, completion double, cost double")
    found = {r.rep: r for r in score.replicate_means(df, 4, 0.7, 7, components=("completion", "cost")).collect()}
    assert set(found) == set(range(4))
    for rep, r in found.items():
        drawn = sorted(rows, key=lambda x: (hashlib.md5(f"7|{rep}|{x[0]}".encode()).hexdigest(), x[0]))[:28]
        values = [Fraction(round(c * 1000), 1000) for _, _, c, _ in drawn if c is not None]
        assert r.n_tasks == 28 and r.mean_cost is None
        assert r.mean_completion == (sum(values) / len(values) * 10000 + Fraction(1, 2)) // 1 / 10000
    noise = score.resampled(df, 4, 0.7, 7).first()
    assert (noise["min"], noise["max"]) == (min(r["mean"] for r in found.values()), max(r["mean"] for r in found.values()))
    assert score.replicate_means(df.limit(4), 4, 0.7, 7, components=("completion",)).count() == 0
    assert score.replicate_means(df.limit(0), 4, 0.7, 7, components=("cost",)).count() == 0


def test_pairs_given_up_repeat(spark):
    dead = spark.createDataFrame([(1, "r1", "a", "f"), (3, "r3", "a", "f"), (2, "r2", "a", None), (4, "r4", None, None)], "ord long, run_id string, strategy string, target_file string")
    assert {tuple(r) for r in history.given_up(dead).collect()} == {("a", "f", 2, "r3"), ("a", None, 1, "r2"), (None, None, 1, "r4")}
    assert history.given_up(dead.limit(0)).count() == 0


def test_a_baseline_without_a_score_fails_the_gates_on_it(spark):
    runs = spark.sql("select 0.9D score_mean, cast(null as double) baseline_score, true has_baseline, 0.9D judge_composite, 0 judge_failed, 0.01D noise_threshold, 0 n_matched, cast(null as double) corrections_composite, true auto, false skip_variance, false skip_judge")
    row = decide.decided(runs).first()
    assert (row.failed, row.decision) == ("delta-floor,variance", "noise-rejected")
    assert decide.decided(runs.withColumn("has_baseline", F.lit(False))).first().decision == "first-real-baseline"


def test_strategies_without_a_name_do_not_count(spark):
    log = spark.sql("select '' strategy, 'kept' decision, current_timestamp() ts union all select 'a', 'kept', current_timestamp()")
    assert [r.strategy for r in history.strategy_stats(log).collect()] == ["a"]


def test_limit_of_sessions_counts_empty_files(spark, tmp_path):
    for folder, name, body in (("a", "1", ""), ("a", "2", json.dumps({"type": "user", "message": {"content": "hello"}})), ("b", "3", json.dumps({"type": "user", "message": {"content": "later"}}))):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.jsonl").write_text(body)
    assert [r.session_id for r in logs.read_sessions(spark, str(tmp_path), 2).collect()] == ["2"]
    assert logs.read_sessions(spark, str(tmp_path), 1).count() == 0 and logs.read_sessions(spark, str(tmp_path)).count() == 2


def test_absent_documents_are_empty(spark, tmp_path):
    assert logs.read_keyed(spark, str(tmp_path / "none"), "a string").count() == 0
    assert logs.read_corrections(spark, str(tmp_path / "none.jsonl")).count() == 0
    assert logs.read_sessions(spark, str(tmp_path / "none")).count() == 0
    assert logs.read_experiment_log(spark, str(tmp_path / "none.jsonl")).columns[:3] == ["ord", "run_id", "ts"]


def test_corrections_need_a_time(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"ts": ts, "prompt": p}) for ts, p in (("2026-01-01T10:00:00Z", "a"), ("soon", "b"), (None, "c"))) + "\n{broken\n[]\n")
    assert [r.prompt for r in logs.read_corrections(spark, str(tmp_path / "c.jsonl")).collect()] == ["a"]


def test_lines_keep_their_order_over_blocks(spark, tmp_path):
    (tmp_path / "big.txt").write_text("\n".join(f"line {i}" if i % 5 else "" for i in range(40_000)))
    (tmp_path / "more.txt").write_text("x\n" * 100)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = logs.read_lines(spark, str(tmp_path)).filter("path like '%big.txt'").orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line for r in rows] == [f"line {i}" for i in range(40_000) if i % 5] and len({r.ord for r in rows}) == 32_000


def test_sessions_are_in_the_order_of_the_written_time(spark, tmp_path):
    (tmp_path / "-home-test").mkdir()
    rows = [("user", "soon", "a prompt of no readable time"), ("user", None, "a prompt of no time"), ("user", "2026-01-01T10:00:00Z", "a prompt with a time")]
    (tmp_path / "-home-test" / "s.jsonl").write_text("\n".join(json.dumps({"type": kind, "message": {"content": text}} | ({"timestamp": ts} if ts else {})) for kind, ts, text in rows))
    assert [r.prompt for r in tasks_of(logs.read_sessions(spark, str(tmp_path))).orderBy("seg").collect()] == [rows[1][2], rows[2][2], rows[0][2]]


def test_calls_end_by_time_and_budget(spark):
    def client(text):
        import time

        if text == "slow":
            time.sleep(3)
        if text == "bad":
            raise ValueError("no")
        return text.upper(), 1.0

    prompts = spark.createDataFrame([("a", "ok"), ("b", "slow"), ("c", "bad")], "benchmark_id string, prompt string")
    rows = {r.benchmark_id: (r.stdout, r.error, r.timed_out) for r in replay.replay(prompts, client, timeout_sec=1.0).collect()}
    assert rows == {"a": ("OK", None, False), "b": (None, "timed out", True), "c": (None, "ValueError: no", False)}
    many = spark.range(20).select(F.col("id").cast("string").alias("benchmark_id"), F.lit("ok").alias("judge_prompt"))
    done = judge.ask(many, client, budget=4.0, tasks=2).collect()
    assert sum(r.cost_usd for r in done) == 4.0 and sum(r.error == "budget spent" for r in done) == 16


def test_a_run_that_all_texts_share_makes_no_pairs(spark, monkeypatch):
    """All prompts hold the same long words; what tells them apart is looked up."""
    shared = "extraordinarily internationalized misunderstandings notwithstanding counterrevolutionaries"
    corrections = [(i, f"c{i} unique{i} w{i} {shared} e{i} z{i} end") for i in range(300)]
    benchmark = [(f"b{i}", f"before c{i} unique{i} w{i} {shared} e{i} z{i} end after") for i in range(0, 300, 2)] + [(f"n{i}", f"other x{i} {shared} y{i} none{i}") for i in range(100)]
    benchmark += [("few", "unique7 w7"), ("part", "nique9 w9 ext"), ("same1", "unique11"), ("same2", "Unique11")]
    made = []
    real = labels.staged
    monkeypatch.setattr(labels, "staged", lambda df: made.append(real(df)) or made[-1])
    out = labels.contained(spark.createDataFrame(benchmark, "benchmark_id string, prompt string"), spark.createDataFrame(corrections, "ord long, prompt string"))
    got = {r.benchmark_id: r.key_ord for r in out.collect()}
    want = {}
    for b, p in benchmark:
        hits = [n for n, c in corrections if c in p.lower() or p.lower() in c]
        if hits:
            want[b] = min(hits)
    assert got == want and len(want) > 150
    assert max(t.count() for t in made) < 300 * 20  # in proportion to the texts' words, not to their pairs


def test_a_budget_is_used_whole_and_no_call_is_made_twice(spark, tmp_path):
    """All the money goes to one uneven task's prompts, round after round; calls are counted outside."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def client(text):
        import uuid

        (calls / f"{text}-{uuid.uuid4().hex}").write_text("")
        return text, 1.0 if text.startswith("dear") else 0.01

    prompts = spark.createDataFrame([(i, f"dear{i}" if i % 8 == 0 else f"cheap{i}") for i in range(80)], "benchmark_id long, judge_prompt string")
    out = judge.ask(prompts, client, budget=6.0, tasks=4)
    rows = out.collect()
    assert out.count() == 80 and len({r.benchmark_id for r in rows}) == 80
    spent = sum(r.cost_usd for r in rows)
    assert 6.0 <= spent + 1e-9 and spent <= 6.0 + 4 and len(list(calls.iterdir())) == sum(r.error is None for r in rows)
    assert all(r.error in (None, judge.UNSENT) for r in rows)


def test_an_error_of_the_code_is_no_failed_call(spark):
    with pytest.raises(Exception, match="unpack"):
        judge.ask(spark.createDataFrame([("a", "p")], "benchmark_id string, judge_prompt string"), lambda text: text).collect()


def test_turns_reach_the_client(spark):
    row = replay.replay(spark.createDataFrame([("a", "p")], "benchmark_id string, prompt string"), lambda prompt, turns: (f"{prompt}{turns}", 0.0), max_turns=12).first()
    assert row.stdout == "p12"


def test_nulls_for_unknown_files(spark):
    b = spark.sql("select 'a' benchmark_id, 2L gt_tool_calls, 3L gt_output_tokens, 'completed' outcome, false correction_logged, array('Edit') calls, 2 files_changed_count")
    assert score.echoed(b).first().files_changed == [None, None] and "files_changed" not in score.echoed(b.drop("files_changed_count")).columns


def test_tables_in_the_order_that_is_shown(spark):
    log = spark.sql("select * from values ('b', 'kept', 1L), ('a', 'kept', 2L), ('c', 'reverted', 0L), ('d', 'kept', 3L), ('d', 'reverted', 4L) t(strategy, decision, ord)").withColumn("ts", F.timestamp_seconds("ord"))
    assert [r.strategy for r in history.period_table(log).collect()] == ["b", "a", "d", "c"]
    assert [r.strategy for r in history.strategy_table(history.strategy_stats(log)).collect()] == ["a", "b", "d", "c"]


def test_a_report_in_pages_lists_every_row(spark):
    log = spark.range(25).select(F.concat(F.lit("r"), "id").alias("run_id"), F.timestamp_seconds(F.col("id") + 1_800_000_000).alias("ts"), F.col("id").alias("ord"), F.lit("memory-add").alias("strategy"), F.lit("kept").alias("decision"), F.lit(0.8).alias("score_mean"), F.lit("c").alias("new_commit"), F.lit("f.md").alias("target_file"))
    since = F.lit("2020-01-01").cast("timestamp")
    pages = [history.weekly_report(log, since, most=10, page=p) for p in range(3)]
    listed = [x.split("`")[1] for text in pages for x in text.splitlines() if x.startswith("- `")]
    assert sorted(listed) == sorted(f"r{i}" for i in range(25)) and "Changes kept (25, page 3 of 3)" in pages[2] and "25 runs in the period" in pages[1]


def test_copies_for_replicates_are_not_broadcast(spark):
    import re

    rows = spark.range(20000).select(F.col("id").alias("benchmark_id"), (F.col("id") % 12).alias("run"), (F.col("id") % 101 / 100).alias("score"))
    for keys in ((), ("run",)):
        lines = score.resampled(rows, 20, 0.7, 42, keys=keys)._jdf.queryExecution().executedPlan().toString().splitlines()
        depth = [len(re.match(r"[\s:+-]*", line)[0]) for line in lines]
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
                assert not any("Generate" in x for x in lines[i:end]), "\n".join(lines[i:end])


def test_options_of_letters_like_ascii(spark):
    texts = ["OPTION a", "optİon 1", "optıon b", "pathc", "choıce 2", "Here are two OPTİONS", "would you like it or not", "no word of it", "", None, "approäch a", "optionally a b", "there are 3 pathſ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = sum((F.col("t").rlike(f"(?idU){p}").cast("int") for p in C.OPTION_PATTERNS), F.lit(0))
    assert all(r.a == r.b for r in df.select(X.options_count(F.col("t")).alias("a"), plain.alias("b")).collect())


def test_phrases_of_texts_outside_ascii(spark):
    df = spark.createDataFrame([("éé Feels Balanced ü feels balanced, TL;DR: 中",), ("中",), ("",), (None,)], "t string")
    assert [r.n for r in df.select(X.phrase_count(F.col("t")).alias("n")).collect()] == [3, 0, 0, None]


def test_texts_longer_than_all_others_are_not_looked_up(spark, monkeypatch):
    asked = []
    plain = labels._by_runs
    monkeypatch.setattr(labels, "_by_runs", lambda short, s, long, t: asked.append({r[0] for r in short.select(s).collect()}) or plain(short, s, long, t))
    b = spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight nine ten eleven twelve")], "benchmark_id long, prompt string")
    c = spark.createDataFrame([(10, "two three four five six", "x"), (11, "and one two three four five six and " + "more " * 50, "x")], "ord long, prompt string, root_cause string")
    assert {tuple(r) for r in labels.contained(b, c).select("benchmark_id", "key_ord").collect()} == {(1, 10)}
    assert {tuple(r) for r in labels.contained(b, c.filter("ord = 11")).select("benchmark_id", "key_ord").collect()} == {(1, 11)}
    assert asked == [{10}, {1, 2}, set(), {1, 2}]
