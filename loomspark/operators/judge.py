"""Rubric judgments: prompts to a judge, its answers, and their means."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import text as X
from ..functions.staging import staged

TEMPLATE = (
    "Rate the response to the prompt from 1 to 5 on: " + ", ".join(C.DIMENSIONS) + ".\n"
    'Answer with one line of JSON with these keys and "rationale", nothing else.\n\n'
    "PROMPT:\n{prompt}\n\nRESPONSE:\n{response}\n\nTOOLS ({n_tools} in all):\n{tools}\n"
)


def judge_prompt(prompt: Column, response: Column, tools: Column) -> Column:
    """The text for a judge; tools is a map of counts."""
    n = F.aggregate(F.map_values(tools), F.lit(0).cast("long"), lambda a, x: a + x)
    shown = X.shown_counts(tools, "×", ", ")
    parts = {"prompt": X.truncated(prompt, 1500), "response": X.truncated(response, 2000), "n_tools": n.cast("string"), "tools": F.when(shown == "", "(no tool calls)").otherwise(shown)}
    out = []
    for piece in TEMPLATE.split("{"):
        name, brace, rest = piece.partition("}")
        out += [F.coalesce(parts[name], F.lit("")), F.lit(rest)] if brace else [F.lit(piece)]
    return F.concat(*out)


def inner_json(text: Column) -> Column:
    """The first line that is a JSON object, or else the first braces around a judgment; null if neither parses."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda line: X.strip(line))
    good = F.filter(lines, lambda line: line.startswith("{") & line.endswith("}") & F.try_parse_json(line).isNotNull())
    loose = F.regexp_extract(text, r"(\{[^{}]*position_taking[^{}]*\})", 1)
    return F.coalesce(F.get(good, F.lit(0)), F.when(F.try_parse_json(loose).isNotNull() & (loose != ""), loose))


def judged(answers: DataFrame) -> DataFrame:
    """answers (benchmark_id, result, cost_usd) with the five values (1 to 5 or null) and judge_failed."""
    out = answers.withColumn("_json", inner_json(F.col("result")))
    values = {d: X.judge_value(F.try_variant_get(F.try_parse_json("_json"), f"$.{d}", "string")) for d in C.DIMENSIONS}
    return out.withColumns(values).withColumn("judge_failed", F.col("_json").isNull()).drop("_json")


def unpivoted(judgments: DataFrame) -> DataFrame:
    return judgments.unpivot(["benchmark_id"], list(C.DIMENSIONS), "dimension", "value")


def dimension_means(judgments: DataFrame) -> DataFrame:
    return unpivoted(judgments).groupBy("dimension").agg(F.round(F.avg((F.col("value") - 1) / 4), 4).alias("mean"), F.count("value").alias("n"))


def judge_summary(judgments: DataFrame, *keys: str) -> DataFrame:
    """One row, or one for each of keys: n_judged, n_failed, total_cost, judge_composite (mean of all values there are)."""
    values = F.array_compact(F.array(*[(F.col(d) - 1) / 4 for d in C.DIMENSIONS]))
    return judgments.groupBy(*keys).agg(
        F.count_if(~F.col("judge_failed")).alias("n_judged"),
        F.count_if("judge_failed").alias("n_failed"),
        F.round(F.sum("cost_usd"), 4).alias("total_cost"),
        F.round(F.try_divide(F.sum(F.aggregate(values, F.lit(0.0), lambda a, x: a + x)), F.sum(F.size(values))), 4).alias("judge_composite"),
    )


def _sent(prompts: DataFrame, client: Callable, timeout_sec: float | None, share: float | None) -> DataFrame:
    """One pass of prompts through the client; each task stops sending once it has spent share."""

    def call(batches):
        pool = ThreadPoolExecutor(1)
        spent = 0.0
        for batch in batches:
            rows = []
            for text in batch["judge_prompt"]:
                if share is not None and spent >= share:
                    rows.append((None, 0.0, UNSENT))
                    continue
                try:
                    answer = pool.submit(client, text).result(timeout_sec)
                except TimeoutError:
                    rows.append((None, 0.0, "timed out"))
                    pool.shutdown(wait=False)
                    pool = ThreadPoolExecutor(1)  # the late call keeps its own thread
                    continue
                except Exception as error:  # what the client raises is a failed call
                    rows.append((None, 0.0, f"{type(error).__name__}: {error}"))
                    continue
                result, cost = answer  # an answer of another shape is an error of the code, and ends the job
                rows.append((result, float(cost), None))
                spent += float(cost)
            yield batch[["benchmark_id"]].assign(result=[r[0] for r in rows], cost_usd=[r[1] for r in rows], error=[r[2] for r in rows])
        pool.shutdown(wait=False)

    kind = prompts.schema["benchmark_id"].dataType.simpleString()
    return prompts.mapInPandas(call, f"benchmark_id {kind}, result string, cost_usd double, error string")


#: Why a prompt that the budget did not reach has no result.
UNSENT = "budget spent"


def ask(prompts: DataFrame, client: Callable[[str], tuple[str, float]], timeout_sec: float | None = None, budget: float | None = None, tasks: int = 8) -> DataFrame:
    """prompts (benchmark_id, unique, and judge_prompt) through a client on the executors: result, cost_usd, error.

    A call that raises or takes longer than timeout_sec has no result, and says why. With a budget
    prompts go out in rounds: each task may spend its share of what is left, and what some do not
    need is shared out anew, among fewer tasks as it runs out. So all of it is used where there is work for it, and it is
    exceeded by one call a task of a round at most. Each round is written, so no call is made twice.
    """
    rows = prompts.select("benchmark_id", "judge_prompt")
    if budget is None:
        return _sent(rows, client, timeout_sec, None)
    pending, left, n_calls, total = staged(rows), budget, 0, 0.0
    whole, answered = pending, []
    while True:
        mean = total / n_calls if n_calls else 0.0
        width = max(1, min(tasks, int(left / mean))) if mean > 0 else tasks
        out = staged(_sent(pending.repartition(width, "benchmark_id"), client, timeout_sec, left / width))
        told = out.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost"), F.count_if(F.col("error").isNull()).alias("calls"), F.count_if(F.col("error").eqNullSafe(UNSENT)).alias("unsent")).first()
        left, total, n_calls = left - told["cost"], total + told["cost"], n_calls + told["calls"]
        over = not told["unsent"] or left <= 1e-12 or not told["cost"]
        answered.append(out if over else out.filter(~F.col("error").eqNullSafe(UNSENT)))
        if over:
            return reduce(DataFrame.unionByName, answered)
        pending = staged(whole.join(out.filter(F.col("error").eqNullSafe(UNSENT)).select("benchmark_id"), "benchmark_id", "left_semi"))
