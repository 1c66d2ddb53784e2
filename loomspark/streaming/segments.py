"""Tasks of sessions as a stream: one open segment a session, closed by the next prompt.

State is keyed by session. It holds the session's tasks that a line may still change: of each what
its settled lines come to, and the lines after the watermark in their order. A line is put where
its time puts it, so a late one changes its own task, a late prompt cuts a task in two; each task
that is not as it was is sent again under a higher version. Lines that the watermark has
passed are summed up, and tasks whose end it has passed are dropped from the state, by an
event-time timer where a session gets no more lines. What the state holds is therefore bounded by the open
task and the lines of the allowed lateness.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.segment import task_columns

#: The state store that state of this kind needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: The parts of a line in their order.
FIELDS = ("at", "ord", "prompt", "project", "tool", "file", "tokens", "chars")
AT, ORD, PROMPT, PROJECT, TOOL, FILE, TOKENS, CHARS = range(8)
TASK = (
    "session_id string, project string, seg long, start_us long, start_ord long, prompt string, last_us long, next_us long, closed boolean, tool_calls long, "
    "output_tokens long, final_response_chars long, files_changed array<string>, calls array<string>, version long"
)


def _key(line: list) -> tuple:
    return (line[AT] is not None, line[AT] or 0, line[ORD])


def _empty() -> dict:
    return {"start": None, "project": None, "prompt": None, "last": None, "tokens": 0, "chars": 0, "files": [], "calls": [], "lines": [], "version": 0, "sent": None}


def settle(task: dict, n: int) -> dict:
    """task with its first n lines summed up; it is not changed itself."""
    out = task | {"files": list(task["files"]), "calls": list(task["calls"]), "lines": task["lines"][n:]}
    for line in task["lines"][:n]:
        if line[PROMPT] is not None and out["start"] is None:
            out |= {"start": [line[AT], line[ORD]], "prompt": line[PROMPT]}
        elif line[PROMPT] is None:
            if line[AT] is not None:
                out["last"] = line[AT]
            out["tokens"] += line[TOKENS] or 0
            if line[CHARS]:
                out["chars"] = line[CHARS]
        out["project"] = out["project"] or line[PROJECT]
        if line[TOOL] is not None:
            out["calls"].append(line[TOOL])
        if line[FILE] is not None and line[FILE] not in out["files"]:
            out["files"].append(line[FILE])
    return out


def _start(task: dict) -> list | None:
    """Time and number of a task's prompt; None of the lines before the first prompt."""
    if task["start"] is not None:
        return task["start"]
    first = task["lines"][0] if task["lines"] else None
    return [first[AT], first[ORD]] if first is not None and first[PROMPT] is not None else None


def _starts(tasks: list[dict]) -> list[tuple]:
    """Keys of the prompts of all tasks but the first."""
    return [(at is not None, at or 0, n) for at, n in map(_start, tasks[1:])]


def put(tasks: list[dict], line: list, starts: list[tuple] | None = None) -> None:
    """Put a line where its time puts it; a prompt begins a task with the lines after it. tasks[0] has what comes before any prompt, or is the first one kept.

    starts is _starts(tasks), which is then kept so: whoever puts many lines reads the tasks once.
    """
    starts = _starts(tasks) if starts is None else starts
    key = _key(line)
    i = bisect.bisect_right(starts, key)
    lines = tasks[i]["lines"]
    where = len(lines) if not lines or _key(lines[-1]) <= key else bisect.bisect_right(lines, key, key=_key)
    if line[PROMPT] is None:
        lines.insert(where, line)
    else:
        tasks.insert(i + 1, _empty() | {"lines": [line, *lines[where:]]})
        del lines[where:]
        starts.insert(i, key)


def put_all(tasks: list[dict], lines: list[list]) -> None:
    """Put lines one after the other; in their order, for a line that comes last is put at once."""
    starts = _starts(tasks)
    for line in sorted(lines, key=_key):
        put(tasks, line, starts)


def packed_line() -> Column:
    """The FIELDS of a row as one string: each column costs a Python worker as much time as all its work on the line."""
    return F.to_json(F.array(*[F.col(f).cast("string") for f in FIELDS]))


def line_of(packed: str) -> list:
    at, n, prompt, project, tool, file, tokens, chars = json.loads(packed)
    return [None if at is None else int(at), int(n), prompt, project, tool, file, None if tokens is None else int(tokens), None if chars is None else int(chars)]


class Segments(StatefulProcessor):
    """Rows of TASK, as JSON, for every task that a batch changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("tasks", "tasks string")

    def _load(self) -> dict:
        return json.loads(self.held.get()[0]) if self.held.exists() else {"base": 0, "settled": None, "tasks": [_empty()]}

    def _changed(self, session: str, state: dict) -> Iterator[Row]:
        tasks = state["tasks"]
        for i, task in enumerate(tasks):
            whole = settle(task, len(task["lines"]))
            if whole["start"] is None:
                continue
            after = _start(tasks[i + 1]) if i + 1 < len(tasks) else None
            row = (whole["project"], state["base"] + i, *whole["start"], whole["prompt"], whole["last"], after[0] if after else None, after is not None, len(whole["calls"]), whole["tokens"], whole["chars"], sorted(whole["files"]), whole["calls"])
            said = json.dumps(row)
            if said != task["sent"]:
                task["sent"], task["version"] = said, task["version"] + 1
                yield TASK_ROW(session, *row, task["version"])

    def _settle(self, state: dict, watermark_us: int) -> None:
        """Sum up the lines that no line can come before any more, and drop tasks that none can change."""
        if watermark_us <= 0:  # there is none yet
            return
        for task in state["tasks"]:
            times = [i for i, line in enumerate(task["lines"]) if line[AT] is not None]
            done = [i for i in times if task["lines"][i][AT] <= watermark_us]
            n = done[-1] + 1 if done else 0
            if n:
                state["settled"] = max(state["settled"] or 0, task["lines"][n - 1][AT])
                task |= settle(task, n)
        while len(state["tasks"]) > 1 and (start := _start(state["tasks"][1])) is not None and start[0] is not None and start[0] <= watermark_us:
            del state["tasks"][0]
            state["base"] += 1

    def _store(self, state: dict, timers) -> None:
        self.held.update((json.dumps(state),))
        times = [line[AT] for task in state["tasks"] for line in task["lines"] if line[AT] is not None]
        if times:  # when the watermark has passed all of them
            self.handle.registerTimer(max(max(times) // 1000 + 1, timers.getCurrentWatermarkInMs() + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._load()
        lines = [line_of(packed) for part in rows for packed in part["line"]]
        if state["settled"] is not None:
            lines = [line for line in lines if line[AT] is not None]  # the others would come before what is settled
        put_all(state["tasks"], lines)
        out = [json.dumps(r.asDict()) for r in self._changed(key[0], state)]
        self._settle(state, timerValues.getCurrentWatermarkInMs() * 1000)
        self._store(state, timerValues)
        if out:
            yield pd.DataFrame({"task": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._load()
        self._settle(state, timerValues.getCurrentWatermarkInMs() * 1000)
        self._store(state, timerValues)
        return iter(())

    def close(self) -> None:
        pass


TASK_ROW = Row(*[c.split()[0] for c in TASK.split(", ")])


def session_messages(spark: SparkSession, root: str, is_prompt, project: Column, files_per_batch: int = 1000) -> DataFrame:
    """New files `<root>/<directory>/<session>[.<part>].jsonl` as messages for task_stream.

    A session may come in parts, numbered in the order of its lines. Lines are numbered by part and
    place; a file is read as one row, for nothing else gives a stream the places of its lines.
    """
    from ..sources.logs import messages

    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).option("wholetext", True).text(root)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\.jsonl$", 1)
    part = F.coalesce(F.regexp_extract(name, r"\.([0-9]+)$", 1).try_cast("long"), F.lit(0))
    lines = files.select(F.regexp_replace(name, r"\.[0-9]+$", "").alias("session_id"), F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+\.jsonl$", 1).alias("directory"), part.alias("part"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    v = F.try_parse_json("line")
    get = lambda p, kind: F.try_variant_get("v", p, kind)
    rows = lines.select("session_id", "directory", (F.col("part") * (1 << 32) + F.col("n")).alias("ord"), v.alias("v")).filter("v is not null").select(
        "session_id", "directory", "ord", get("$.timestamp", "string").alias("ts_raw"), get("$.timestamp", "string").try_cast("timestamp").alias("ts"),
        get("$.type", "string").alias("type"), get("$.message.content", "variant").alias("content"), F.coalesce(get("$.message.usage.output_tokens", "long"), F.lit(0)).alias("tokens"),
    )
    return messages(rows.filter(F.col("type").isin("user", "assistant")), is_prompt, project).drop("ts_raw")


def task_stream(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """Changes of tasks as the messages come: the columns of task_rows but for timestamps' kind, with closed and version.

    messages is a stream of (session_id, project, ord, ts, is_prompt, prompt, tool, file, tokens, text_chars). The row of highest version
    of a session's start_ord is the task as it stands. Lines that are later than late are left out, and so are lines without a
    time once a session has settled ones. Order is by time and ord, nulls first.
    """
    from ..functions.text import strip

    messages.sparkSession.conf.set(*STATE_STORE)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = messages.select(
        "session_id", F.col("ts").cast("timestamp").alias("time"), at.alias("at"), F.col("ord").cast("long").alias("ord"), F.when(F.col("is_prompt"), F.coalesce(strip(F.col("prompt")), F.lit(""))).alias("prompt"),
        "project", "tool", "file", F.col("tokens").cast("long").alias("tokens"), F.col("text_chars").cast("long").alias("chars"),
    )
    rows = rows.select("session_id", "time", packed_line().alias("line")).withWatermark("time", late)
    packed = rows.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Segments(), outputStructType="task string", outputMode="Update", timeMode="eventTime")
    tasks = packed.select(F.from_json("task", TASK, {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)}).alias("t")).select("t.*")
    timed = {f"{c}_ts": F.timestamp_micros(f"{c}_us") for c in ("start", "last", "next")}
    return task_columns(tasks.withColumns(timed).drop("start_us", "last_us", "next_us"))

