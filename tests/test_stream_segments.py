"""Streams of session lines and of log rows, held to the batch result."""

import json
import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import decide, history, segment
from loomspark.plans import adapters as A
from loomspark.sources import logs
from loomspark.streaming import changes

pytest.importorskip("google.protobuf")
from loomspark.streaming import segments as S  # noqa: E402

SF = "/root/testdata/sf0.001"
SHAPE = "session_id string, project string, ord long, ts timestamp, is_prompt boolean, prompt string, tool string, file string, tokens long, text_chars long"
DAY = datetime(2026, 1, 1)
COLUMNS = ("session_id", "seg", "project", "start_ord", "start_ts", "end_ts", "prompt", "prompt_chars", "duration_sec", "task_id", "tool_calls", "output_tokens", "final_response_chars", "files_changed", "calls", "tools")


def rows_of(df):
    return sorted(str([df_row[c] for c in COLUMNS]) for df_row in df.collect())


def feed(spark, tmp_path, batches, late="10 days", n=1, name="t"):
    """Each batch is a file; the stream is stopped and started again after every n of them."""
    source, root, state = (str(tmp_path / f"{name}-{x}") for x in ("in", "table", "state"))
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SHAPE).coalesce(1).write.mode("append").parquet(f"{source}/{i:04d}")
        if i % n == n - 1 or i == len(batches) - 1:
            stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
            changes.keep(S.task_stream(stream, late), root, state).awaitTermination()
    return root


def line(i, minute, kind, session="a"):
    ts = None if minute is None else DAY + timedelta(minutes=minute)
    return (session, "p", i, ts, kind == "prompt", f" do {i} " if kind == "prompt" else None, "Bash" if kind == "tool" else None, f"f{i % 3}" if kind == "tool" else None, i % 9, i % 50 if kind == "text" else 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_batch_split_gives_the_batch_rows(spark, tmp_path, seed):
    draw = random.Random(seed)
    lines = [line(i, draw.choice([None, *range(60)]), draw.choice(["prompt", "tool", "text", "text"]), draw.choice("abc")) for i in range(150)]
    draw.shuffle(lines)
    cuts = sorted(draw.sample(range(1, 150), 4))
    batches = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, 150], strict=True)]
    root = feed(spark, tmp_path, batches, n=2)
    got = changes.current(spark, root, ["session_id", "start_ord"], "version")
    assert rows_of(got) == rows_of(segment.task_rows(spark.createDataFrame(lines, SHAPE)))
    changes.compact(spark, root, ["session_id", "start_ord"], "version")
    assert rows_of(changes.current(spark, root, ["session_id", "start_ord"], "version")) == rows_of(got)


def test_events_as_a_stream(spark, tmp_path):
    """The rows of segment_tasks, from its table in three files."""
    messages = A.messages(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    for i in range(3):
        messages.filter(F.col("ord") % 3 == i).coalesce(1).write.parquet(f"{source}/{i}")
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    changes.keep(S.task_stream(stream, "400 days"), str(tmp_path / "t"), str(tmp_path / "s")).awaitTermination()
    assert rows_of(changes.current(spark, str(tmp_path / "t"), ["session_id", "start_ord"], "version")) == rows_of(segment.task_rows(messages))


def test_a_late_line_changes_exactly_its_task(spark, tmp_path):
    on_time = [line(1, 0, "prompt"), line(2, 1, "tool"), line(3, 10, "prompt"), line(4, 11, "text"), line(5, 20, "prompt"), line(6, 21, "tool")]
    late = [line(7, 12, "tool")]
    prompt = [line(8, 11.5, "prompt")]
    root = feed(spark, tmp_path, [on_time, late, prompt])
    versions = {}
    for part in sorted(S_parts(spark, root)):
        for r in part[1]:
            versions.setdefault(part[0], []).append((r.start_ord, r.version))
    one, two, three = (sorted(versions.get(k, [])) for k in sorted(versions)[:3])
    assert one == [(1, 1), (3, 1), (5, 1)]
    assert two == [(3, 2)]  # the task of the late line, and no other
    assert three == [(3, 3), (5, 2), (8, 1)]  # cut in two, and the one after it numbered anew
    got = changes.current(spark, root, ["session_id", "start_ord"], "version")
    assert rows_of(got) == rows_of(segment.task_rows(spark.createDataFrame(on_time + late + prompt, SHAPE)))


def S_parts(spark, root):  # noqa: N802
    from loomspark.sources import snapshots

    return [(name, spark.read.parquet(f"{root}/{path}").collect()) for name, path in snapshots.parts(spark, root).items() if spark.read.parquet(f"{root}/{path}").count()]


def test_state_is_settled_behind_the_watermark(spark, tmp_path):
    """Lines later than the allowed lateness are left out; what came in time is whole."""
    first = [line(i, i, "prompt" if i % 4 == 0 else "text") for i in range(40)]
    then = [line(100, 300, "prompt"), line(101, 301, "tool")]
    last = [line(102, 302, "text"), line(103, 5, "tool")]  # the second is five hours late
    root = feed(spark, tmp_path, [first, then, last, [line(104, 303, "tool")]], late="30 minutes")
    got = changes.current(spark, root, ["session_id", "start_ord"], "version")
    kept = first + then + last[:1] + [line(104, 303, "tool")]
    assert rows_of(got) == rows_of(segment.task_rows(spark.createDataFrame(kept, SHAPE)))


def test_settling_keeps_the_open_task_and_the_numbers():
    tasks = [S._empty()]
    for i in range(10):
        S.put(tasks, [i * 10, i, "go" if i % 3 == 0 else None, "p", None, None, 1, 5])
    state = {"base": 0, "settled": None, "tasks": tasks}
    processor = S.Segments()
    before = [(r.seg, r.start_ord, r.output_tokens) for r in processor._changed("s", state)]
    processor._settle(state, 75)
    assert state["base"] == 3 and len(state["tasks"]) == 2 and [len(t["lines"]) for t in state["tasks"]] == [1, 1]
    assert list(processor._changed("s", state)) == [] and before == [(1, 0, 2), (2, 3, 2), (3, 6, 2), (4, 9, 0)]


def test_many_lines_of_a_session_read_its_tasks_once(monkeypatch):
    draw = random.Random(3)
    lines = [[draw.choice([None, *range(900)]), i, "go" if i % 3 == 0 else None, "p", None, None, 1, 5] for i in range(1500)]
    one_by_one, together = [S._empty()], [S._empty()]
    for x in lines:
        S.put(one_by_one, x)
    start, read = S._start, []
    monkeypatch.setattr(S, "_start", lambda task: read.append(1) or start(task))
    S.put_all(together, lines[:700])
    S.put_all(together, lines[700:])
    assert together == one_by_one and len(together) == 501
    assert len(read) < 1000  # not each task for each line


def test_a_line_goes_to_python_packed_and_whole(spark, tmp_path):
    """Each column and row costs a worker time; texts, nulls and large numbers come through the packing as they are."""
    odd = ' "do" \\ it\n\t\u0001 [1,null] {"a":"b"} \u00e9\u2028\U0001f600 null '
    at = [DAY + timedelta(microseconds=i) for i in range(9)]
    rows = [
        ("a", None, 2**53 + 1, at[0], True, odd, None, None, None, None), ("a", odd, 2**53 + 2, at[1], False, None, odd, odd, 2**53 + 3, 7),
        ("a", "p", 2**53 + 5, at[1], True, "go", None, None, 1, 0), ("a", "p", 2**53 + 6, at[3], False, None, "null", "", None, None),
        (None, "p", 1, None, True, "no time", None, None, None, None), (None, "p", 2, at[2], False, None, "Bash", None, 4, None), ("", None, -5, DAY - timedelta(days=1), True, "", None, None, None, None),
    ]
    messages = spark.createDataFrame(rows, SHAPE)
    root = feed(spark, tmp_path, [rows[::2], rows[1::2]])
    got = changes.current(spark, root, ["session_id", "start_ord"], "version")
    assert rows_of(got) == rows_of(segment.task_rows(messages)) and got.count() == 4
    stream = spark.readStream.schema(SHAPE).parquet(str(tmp_path / "t-in" / "*"))
    plan = S.task_stream(stream)._jdf.queryExecution().logical().toString()
    sent = plan[plan.index("transformWithStateUDF(") :].split("(")[1].split(")")[0].split(", ")
    assert [c.split("#")[0] for c in sent] == ["session_id", "time", "line"]


def test_session_files_in_parts(spark, tmp_path):
    def write(folder, name, lines):
        (tmp_path / folder / "-home-me").mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "-home-me" / f"{name}.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\n{broken")

    def message(minute, kind, content):
        return {"type": kind, "timestamp": f"2026-01-01T10:{minute:02}:00Z", "message": {"content": content, "usage": {"output_tokens": minute}}}

    a = [message(0, "user", "first prompt"), message(1, "assistant", [{"type": "tool_use", "name": "Edit", "input": {"file_path": "x.py"}}]), message(2, "assistant", [{"type": "text", "text": "done"}]), message(5, "user", "second prompt"), message(7, "assistant", [{"type": "text", "text": "longer answer"}])]
    write("whole", "s1", a)
    want = segment.task_rows(logs.messages(logs.read_sessions(spark, str(tmp_path / "whole")), X.is_prompt, X.project_of(F.col("directory"), "me")))
    for i, part in enumerate((a[:1], a[1:4], a[4:])):
        write("parts", f"s1.{i}", part)
        stream = S.session_messages(spark, str(tmp_path / "parts"), X.is_prompt, X.project_of(F.col("directory"), "me"))
        changes.keep(S.task_stream(stream), str(tmp_path / "t"), str(tmp_path / "s")).awaitTermination()
    names = ("session_id", "seg", "prompt", "duration_sec", "calls", "files_changed", "output_tokens", "final_response_chars", "project")
    show = lambda df: sorted(str([r[c] for c in names]) for r in df.collect())
    assert show(changes.current(spark, str(tmp_path / "t"), ["session_id", "start_ord"], "version")) == show(want)


LOG = "ord long, ts timestamp_ntz, run_id string, strategy string, target_file string, decision string, score_mean double, new_commit string, stream long"


@pytest.mark.parametrize("kind", ["stats", "baseline"])
def test_history_kept_up_to_date_through_a_kill(spark, tmp_path, monkeypatch, kind):
    log = A.run_log(spark, SF)
    source, root, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    made = {"stats": changes.strategy_changes, "baseline": changes.baseline_changes}[kind]
    keys = {"stats": ["strategy"], "baseline": ["key"]}[kind]

    def run():
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
        changes.keep(made(stream), root, state).awaitTermination()

    commit = changes.snapshots.commit

    def killed(rows, *rest):
        commit(rows, *rest)
        raise RuntimeError("killed after the write, before the stream's own commit")

    for i in range(4):
        log.filter(F.col("ord") % 4 == i).coalesce(1).write.parquet(f"{source}/{i}")
        if i == 2:
            monkeypatch.setattr(changes.snapshots, "commit", killed)
            with pytest.raises(Exception, match="killed"):
                run()
            monkeypatch.setattr(changes.snapshots, "commit", commit)
        run()
    got = changes.current(spark, root, keys).drop("key")
    want = history.strategy_stats(log) if kind == "stats" else decide.latest_baseline(log)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count()
    shutil.rmtree(state)
