"""Sessions, spans and budgets that hold much of the table."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.operators import history, segment

SHAPE = "session_id string, project string, ord long, ts timestamp_ntz, is_prompt boolean, prompt string, tool string, file string, tokens long, text_chars long"
DAY = datetime(2026, 1, 1)


def drawn(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        kind = draw.choice(["prompt", "tool", "text"])
        ts = None if draw.random() < 0.05 else DAY + timedelta(seconds=draw.randrange(40_000))
        rows.append(("hot" if i % 2 else f"s{draw.randrange(40)}", "p", i, ts, kind == "prompt", f" do {i} " if kind == "prompt" else None, "Bash" if kind == "tool" else None, f"f{i % 3}" if kind == "tool" else None, i % 9, i % 50 if kind == "text" else 0))
    draw.shuffle(rows)
    return rows


def by_window(messages):
    """Tasks by a window over each session, worked out the plain way."""
    w = Window.partitionBy("session_id").orderBy(F.col("ts").asc_nulls_first(), "ord")
    rows = messages.withColumn("seg", F.sum(F.col("is_prompt").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("seg > 0").collect()
    tasks = {}
    for r in sorted(rows, key=lambda r: (r.ts is not None, r.ts or DAY, r.ord)):
        tasks.setdefault((r.session_id, r.seg), []).append(r)
    out = {}
    for key, own in tasks.items():
        after = tasks.get((key[0], key[1] + 1))
        answers = [r.ts for r in own[1:] if r.ts]
        end = (after[0].ts if after else None) or (answers[-1] if answers else None) or own[0].ts
        out[key] = (own[0].ts, end, own[0].prompt.strip(), [r.tool for r in own if r.tool], sum(r.tokens for r in own[1:]), sorted({r.file for r in own if r.file}), next((r.text_chars for r in reversed(own[1:]) if r.text_chars), 0))
    return out


def test_a_session_with_half_the_table(spark):
    messages = spark.createDataFrame(drawn(3000), SHAPE).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = segment.task_rows(messages)
        assert "Window" not in tasks._jdf.queryExecution().toString()
        got = {(r.session_id, r.seg): (r.start_ts, r.end_ts, r.prompt, r.calls, r.output_tokens, r.files_changed, r.final_response_chars) for r in tasks.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == by_window(messages)


def test_spans_cover_and_do_not_overlap(spark):
    draw = random.Random(2)
    pairs = [(a, a + draw.choice([0, 1, 2, 3, 100, 12345, 10**6])) for a in [0, 1, -1, -77, 5, 1023, -(10**6), 987_654] for _ in range(4)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", segment.span_nodes(F.col("a"), F.col("b")).alias("n"))
    for r in df.collect():
        cells = sorted((x.node << x.level, (x.node + 1) << x.level) for x in r.n)
        assert cells[0][0] == r.a and cells[-1][1] == r.b + 1 and all(p[1] == q[0] for p, q in zip(cells, cells[1:], strict=False))
        assert len(r.n) <= 2 * (r.b - r.a + 1).bit_length()


def test_long_tasks_against_corrections(spark):
    """Tasks of seconds to twenty years, held to brute force; copies stay logarithmic."""
    draw = random.Random(3)
    at = lambda: DAY + timedelta(seconds=draw.randrange(-600_000_000, 600_000_000), microseconds=draw.randrange(10**6))
    tasks = []
    for i in range(300):
        start = at() if i % 50 else None
        tasks.append((f"s{i}", i, draw.choice(["P1", "p2", "workspace", None]), start, start and start + timedelta(seconds=draw.choice([0, 5, 3600, 86_400, 40_000_000, 600_000_000]))))
    edge = tasks[7]
    corrections = [(at(), draw.choice(["p1", "P2", "p3"])) for _ in range(60)] + [(edge[4], "WorkSpace"), (edge[3], None), (DAY, "")]
    t = spark.createDataFrame(tasks, "session_id string, seg int, project string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    c = spark.createDataFrame(corrections, "ts timestamp_ntz, project string")
    for tolerance in (0, 90):
        slack = timedelta(seconds=tolerance)
        want = {
            (s, n) for s, n, p, a, b in tasks if a is not None and any(a - slack <= ts <= b + slack and ((q or "").lower() in ("", "workspace") or (p is not None and q.lower() == p.lower())) for ts, q in corrections)
        }
        assert {tuple(r) for r in segment.corrected_tasks(t, c, tolerance).collect()} == want
    assert 7 in {n for _, n in want}


def test_budget_of_a_whole_run(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice([0.25, 0.5, 3.0, None])) for i in range(2000)]
    df = spark.createDataFrame(draw.sample(rows, len(rows)), "ord long, cost double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = history.within_budget(df, 700.0)
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.ord, r.spent_before) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spent, want = 0.0, set()
    for i, cost in rows:
        if spent < 700.0:
            want.add((i, spent))
        spent += cost or 0.0
    assert got == want
