"""Replayed runs: reading a model's output, and counting outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .judge import ask as _ask


def parsed(outputs: DataFrame) -> DataFrame:
    """outputs (benchmark_id, stdout, returncode, timed_out) with response_text, output_tokens, calls, completed_cleanly, parse_error.

    stdout is one JSON object, with the final text in `result` or turns in `messages` or
    `transcript`; what does not parse is kept as text, 2000 characters of it.
    """
    v = F.try_parse_json("stdout")
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    base = outputs.withColumn("_v", v)
    turns = F.coalesce(get("$.messages", "array<variant>"), get("$.transcript", "array<variant>"))
    parts = F.flatten(
        F.transform(
            F.coalesce(turns, F.array().cast("array<variant>")),
            lambda m: F.transform(
                F.coalesce(F.try_variant_get(m, "$.content", "array<variant>"), F.array().cast("array<variant>")),
                lambda p: F.struct(
                    F.try_variant_get(m, "$.role", "string").alias("role"),
                    F.try_variant_get(p, "$.type", "string").alias("type"),
                    F.try_variant_get(p, "$.name", "string").alias("name"),
                    F.try_variant_get(p, "$.text", "string").alias("text"),
                ),
            ),
        )
    )
    base = base.withColumn("_parts", parts)
    texts = F.filter("_parts", lambda p: (p["type"] == "text") & (p["role"] == "assistant") & (F.coalesce(p["text"], F.lit("")) != ""))
    calls = F.transform(F.filter("_parts", lambda p: p["type"] == "tool_use"), lambda p: F.coalesce(p["name"], F.lit("unknown")))
    error = F.col("_v").isNull()
    ok = (F.coalesce(get("$.subtype", "string"), F.lit("")) == "success") | (F.coalesce(get("$.is_error", "string"), F.lit("")) == "false")
    return base.select(
        *outputs.columns,
        F.when(error, F.left("stdout", F.lit(2000))).otherwise(F.coalesce(F.try_element_at(texts, F.lit(-1))["text"], get("$.result", "string"), F.lit(""))).alias("response_text"),
        F.coalesce(get("$.usage.output_tokens", "long"), F.lit(0)).alias("output_tokens"),
        calls.alias("calls"),
        (~error & ok & (F.coalesce("returncode", F.lit(0)) == 0) & ~F.coalesce("timed_out", F.lit(False))).alias("completed_cleanly"),
        error.alias("parse_error"),
    )


def replay_summary(runs: DataFrame, *keys: str) -> DataFrame:
    """Counts of runs (timed_out, completed, n_tool_calls, cost): a time-out counts before a completion, that before a failure."""
    late, done = F.coalesce("timed_out", F.lit(False)), F.coalesce("completed", F.lit(False))
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(late).alias("timed_out"),
        F.count_if(~late & done).alias("completed"),
        F.count_if(~late & ~done).alias("failed"),
        F.count_if(F.col("n_tool_calls") > 0).alias("with_tools"),
        F.round(F.sum("cost"), 2).alias("total_cost"),
    ).withColumn("invalid", (F.col("attempted") > 0) & (F.col("completed") == 0))


def replay(prompts: DataFrame, client: Callable[..., tuple[str, float]], timeout_sec: float | None = None, budget: float | None = None, tasks: int = 8, max_turns: int | None = None) -> DataFrame:
    """prompts (benchmark_id, prompt) through a client on the executors: stdout, cost_usd, error, timed_out. Time and budget as in judge.ask.

    With max_turns the client is called with it as a second argument, and is to stop a task after so many turns.
    """
    limited = client if max_turns is None else (lambda prompt: client(prompt, max_turns))
    answers = _ask(prompts.select("benchmark_id", F.col("prompt").alias("judge_prompt")), limited, timeout_sec, budget, tasks)
    return answers.withColumnRenamed("result", "stdout").withColumn("timed_out", F.col("error").eqNullSafe("timed out"))
