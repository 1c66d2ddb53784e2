"""Messages to tasks: a task runs from one prompt of the user's to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import config as C
from ..functions import text as X
from ..functions.ordered import running


def micros(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def seconds(us: Column) -> Column:
    """Seconds to one place, half up, never negative."""
    return F.floor((F.greatest(F.lit(0).cast("long"), us) + 50_000) / 100_000) / 10.0


def _time(messages: DataFrame) -> Column:
    return F.col("ts_raw") if "ts_raw" in messages.columns else F.col("ts")


def segmented(messages: DataFrame) -> DataFrame:
    """messages with seg, counted from 1 in each session; what comes before a session's first prompt is dropped.

    Columns used: session_id, ts, ord, is_prompt, and ts_raw if there is one. Order is by time, nulls
    first, then ord; where there is ts_raw, the time as it was written, by that text. Prompts are counted
    in ranges of sessions and times, so a session may hold any part of the table.
    """
    order = [_time(messages).asc_nulls_first(), F.col("ord").asc()]
    return running(messages, ["session_id"], order, {"seg": F.col("is_prompt").cast("int")}).filter("seg > 0")


def task_rows(messages: DataFrame) -> DataFrame:
    """One row per task, from messages (session_id, project, ord, ts, is_prompt, prompt, tool, file, tokens, text_chars).

    A prompt is a row of its own task and, by its time alone, of the one before it, which it ends.
    """
    place = F.struct(_time(messages).alias("at"), F.col("ord"))
    rows = segmented(messages)
    ends = F.struct((F.col("seg") - 1).alias("seg"), F.lit(True).alias("ends"))
    own = F.struct(F.col("seg"), F.lit(False).alias("ends"))
    rows = rows.withColumn("_in", F.explode(F.when(F.col("is_prompt") & (F.col("seg") > 1), F.array(own, ends)).otherwise(F.array(own)))).withColumns({"seg": F.col("_in.seg"), "_ends": F.col("_in.ends")}).drop("_in")
    inside = ~F.col("_ends")
    prompt, answer = inside & F.col("is_prompt"), inside & ~F.col("is_prompt")
    mine = lambda c: F.when(inside, F.col(c))
    grouped = rows.groupBy("session_id", "seg").agg(
        F.first(mine("project"), ignorenulls=True).alias("project"),
        F.max(F.when(prompt, F.col("ts"))).alias("start_ts"),
        F.max(F.when(prompt, F.col("ord"))).alias("start_ord"),
        F.max(F.when(prompt, X.strip(F.col("prompt")))).alias("prompt"),
        F.max_by("ts", F.when(answer & F.col("ts").isNotNull(), place)).alias("last_ts"),
        F.max(F.when(F.col("_ends"), F.col("ts"))).alias("next_ts"),
        F.count(mine("tool")).alias("tool_calls"),
        F.sum(F.when(answer, F.coalesce("tokens", F.lit(0))).otherwise(0)).cast("long").alias("output_tokens"),
        F.coalesce(F.max_by("text_chars", F.when(answer & (F.col("text_chars") > 0), place)), F.lit(0)).cast("long").alias("final_response_chars"),
        F.array_sort(F.collect_set(mine("file"))).alias("files_changed"),
        F.transform(F.array_sort(F.collect_list(F.when(inside & F.col("tool").isNotNull(), F.struct(_time(messages).alias("at"), "ord", "tool")))), lambda x: x["tool"]).alias("calls"),
    )
    return task_columns(grouped)


def task_columns(tasks: DataFrame) -> DataFrame:
    """tasks with what follows from their other columns: tools, end_ts (the next prompt's time, else the last answer's), duration_sec, task_id, prompt_chars."""
    distinct = F.array_sort(F.array_distinct("calls"))
    return (
        tasks.withColumn("tools", F.map_from_arrays(distinct, F.transform(distinct, lambda t: F.size(F.filter("calls", lambda u: u == t)).cast("long"))))
        .withColumn("end_ts", F.coalesce("next_ts", "last_ts", "start_ts"))
        .withColumn("duration_sec", seconds(micros(F.col("start_ts"), F.col("end_ts"))))
        .withColumn("task_id", F.format_string("%s-%03d", F.left("session_id", F.lit(8)), F.col("seg") - 1))
        .withColumn("prompt_chars", F.length("prompt"))
        .drop("next_ts")
    )


#: Least time span of a join key, as a power of two of microseconds (71 minutes), and how often it can double: to more than all times.
CELL_BITS, LEVELS = 32, 31


def _micros_of(ts: Column, zoned: bool) -> Column:
    """Microseconds since 1970; zoned: of a point in time, else of the time that a clock shows."""
    return F.unix_micros(ts.cast("timestamp")) if zoned else micros(F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def span_nodes(start: Column, end: Column) -> Column:
    """The dyadic spans (level, node) that cover the cells from start to end (cell numbers, both included): two a level at most."""
    level = F.sequence(F.lit(0), F.lit(LEVELS))
    shifted = lambda x, k: F.call_function("shiftright", x, k)

    def at(k: Column) -> Column:
        low, high = -shifted(-start, k), shifted(end + 1, k)  # of the spans of this level that lie inside
        node = lambda n, odd: F.when((low < high) & (odd.bitwiseAND(F.lit(1)) == 1), F.struct(k.alias("level"), n.alias("node")))
        return F.array(node(low, low), node(high - 1, high))

    return F.filter(F.flatten(F.transform(level, at)), lambda x: x.isNotNull())


def point_nodes(cell: Column) -> Column:
    """The spans (level, node) of all levels that hold a cell."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", cell, k).alias("node")))


def corrected_tasks(tasks: DataFrame, corrections: DataFrame, tolerance_sec: int = 0) -> DataFrame:
    """Keys (session_id, seg) of tasks with a correction in their time span and of their project.

    A correction without a project, or of `workspace`, fits any. A task is cut in dyadic spans of time and a
    correction lies in one span of each level, so the copies of either grow with the logarithm of the
    time; they meet by project and span, a task ends at its first match, and neither side is broadcast whole.
    """
    slack = tolerance_sec * 1_000_000
    cell = lambda us: F.call_function("shiftright", us, F.lit(CELL_BITS))
    named = lambda p: F.concat(F.lit("="), F.lower(p))
    zoned = any(isinstance(t, T.TimestampType) for t in (tasks.schema["start_ts"].dataType, tasks.schema["end_ts"].dataType, corrections.schema["ts"].dataType))
    t = tasks.select("session_id", "seg", (_micros_of(F.col("start_ts"), zoned) - slack).alias("low"), (_micros_of(F.col("end_ts"), zoned) + slack).alias("high"), F.explode(F.array(F.lit("*"), named(F.col("project")))).alias("of"))
    t = t.select("*", F.explode(span_nodes(cell(F.col("low")), cell(F.col("high")))).alias("at")).select("session_id", "seg", "low", "high", "of", "at.level", "at.node")
    project = F.lower(F.coalesce("project", F.lit("")))
    c = corrections.select(_micros_of(F.col("ts"), zoned).alias("us"), F.when(project.isin("", "workspace"), "*").otherwise(named(project)).alias("of")).distinct()
    c = c.select("us", "of", F.explode(point_nodes(cell(F.col("us")))).alias("at")).select("us", F.col("of").alias("_of"), F.col("at.level").alias("_level"), F.col("at.node").alias("_node"))
    met = (F.col("of") == F.col("_of")) & (F.col("level") == F.col("_level")) & (F.col("node") == F.col("_node"))
    return t.join(c, met & F.col("us").between(F.col("low"), F.col("high")), "left_semi").select("session_id", "seg").distinct()


def enriched(tasks: DataFrame, corrections: DataFrame, s: C.Settings = C.DEFAULTS) -> DataFrame:
    """tasks with correction_logged, outcome, task_type and difficulty."""
    hit = corrected_tasks(tasks, corrections).withColumn("_hit", F.lit(True))
    logged = F.coalesce("_hit", F.lit(False))
    return (
        tasks.join(hit, ["session_id", "seg"], "left")
        .withColumn("correction_logged", logged)
        .withColumn("outcome", X.outcome(F.col("duration_sec"), F.col("tool_calls"), F.col("final_response_chars"), F.col("correction_logged"), s))
        .withColumn("task_type", X.task_type(F.col("prompt"), F.col("tools"), F.size("files_changed")))
        .withColumn("difficulty", X.difficulty(F.col("duration_sec"), s))
        .drop("_hit")
    )
