"""The driver's tables in the shape of sessions, corrections, responses and a run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prompts by event number: each takes another branch of the classifier or the filters.
PROMPTS = (
    "Please fix the broken login page, it shows an error.",
    "Audit the config and verify every entry",
    "Write a short doc about the release steps",
    "How should we design the cache layer?",
    "Summarize what happened here in plain words please",
    "<b>note</b> tagged prompt that begins with a bracket",
    "/status show the current state of all jobs",
    "hi there",
)
#: Texts appended to responses: phrases and options patterns, by number.
SUFFIXES = (
    "", " It feels balanced. Let me know if it works.", " There are three options here.", " Would you like this or that?", " TL;DR: done. tl;dr: done.",
    " Take option b.", " To summarize, in summary, it is ultimately your call.", " First gh search found it.", " i think the right call is tldr: no", " Deferred until later, either approach works.",
)
DECISIONS = ("kept", "reverted", "noise-rejected", "seed", "first-real-baseline", "sanity-floor-rejected", "user-reverted")
STRATEGY_NAMES = ("rule-rewrite", "memory-add", "rule-reorder")
AS_OF = "2024-03-15 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], number) -> F.Column:
    """values[number % len(values)]."""
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a stream of files; a pattern, for a stream reads a single file by no other name."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def messages(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """events: a sign-up is a prompt, an error a text reply, the rest are tool calls; a user is a session."""
    kind, n = F.col("event_type"), F.col("event_id")
    return (table(spark, sf_dir, "events") if events is None else events).select(
        F.col("user_id").cast("string").alias("session_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project"),
        n.alias("ord"),
        "ts",
        (kind == "signup").alias("is_prompt"),
        F.when(kind == "signup", pick(PROMPTS, n)).alias("prompt"),
        F.when(kind == "click", "Read").when(kind == "view", "Bash").when(kind == "purchase", "Edit").alias("tool"),
        F.when(kind == "purchase", F.concat(F.lit("src/f"), (n % 7).cast("string"), F.lit(".py"))).alias("file"),
        F.floor("value").cast("long").alias("tokens"),
        F.when(kind == "error", n % 200).otherwise(F.lit(0)).cast("long").alias("text_chars"),
    )


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: errors whose property k is 95 or more."""
    rows = table(spark, sf_dir, "events").filter((F.col("event_type") == "error") & (F.get_json_object("props", "$.k").cast("int") >= 95))
    project = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "workspace").otherwise(F.concat(F.lit("P"), (F.col("user_id") % 5).cast("string")))
    return rows.select("ts", project.alias("project"), F.col("event_id").alias("ord"), F.concat(F.lit("cause-"), (F.col("event_id") % 9).cast("string")).alias("root_cause"))


def run_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """events as runs: a strategy by user, a decision by event number, a score by value."""
    from ..functions.config import STRATEGIES

    n = F.col("event_id")
    return (table(spark, sf_dir, "events") if events is None else events).select(
        n.alias("ord"),
        "ts",
        F.concat(F.lit("run-"), n.cast("string")).alias("run_id"),
        F.when(F.col("user_id") % 6 == 5, "user-approval").otherwise(pick(STRATEGIES, F.col("user_id"))).alias("strategy"),
        F.concat(F.lit("memory/m"), (n % 11).cast("string"), F.lit(".md")).alias("target_file"),
        pick(DECISIONS, n).alias("decision"),
        F.when(n % 13 != 0, F.lit(0.5) + (F.floor("value") % 50) / 100).alias("score_mean"),
        F.concat(F.lit("c"), n.cast("string")).alias("new_commit"),
        (F.col("user_id") % 20).alias("stream"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as reports: one a day, and a weekly one every Monday."""
    day = F.date_format("ts", "yyyy-MM-dd")
    names = F.when(F.weekday("ts") == 0, F.array(F.concat(day, F.lit(".md")), F.concat(F.lit("weekly-"), day, F.lit(".md")))).otherwise(F.array(F.concat(day, F.lit(".md"))))
    return table(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.explode(names).alias("name")).distinct()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a suffix by number, and a prompt: an opening by number and then the whole text."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("text"), pick(SUFFIXES, n)).alias("text"), F.concat(pick(PROMPTS, n), F.lit(" "), F.col("text")).alias("prompt"))


#: What a correction says should have been done, and what was done, by number.
SUPPOSED = ("take a position and name the options", "summarize the right call", "show three choices with a summary")
DONE = ("deferred everything until later", "said that it feels balanced", "asked which option to take")


def task_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: errors as corrections of prompts: the prompt in other case and spacing, a part of one, one with more words, or none of them."""
    n = F.col("event_id")
    step = F.floor(n / 4)
    prompt = (
        F.when(n % 4 == 0, F.concat(F.lit("  "), F.upper(pick(PROMPTS[:3], step))))
        .when(n % 4 == 1, F.lit("short doc about the release"))
        .when(n % 4 == 2, F.concat(pick(PROMPTS[3:6], step), F.lit(" and more words after it")))
        .otherwise(F.lit("unrelated words that nobody asked for"))
    )
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return rows.select(n.alias("ord"), prompt.alias("prompt"), F.concat(F.lit("cause-"), (n % 9).cast("string")).alias("root_cause"), pick(SUPPOSED, n).alias("supposed_to"), pick(DONE, n).alias("what_i_did"))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents as files: commit b<2n> has document n, and c<2n>, its child, the document with lines moved, repeated, dropped and added.

    One in six has no version in the child, and one in six none in the parent. Also the commits with their parents.
    """
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.split("text", "\n")
    turned = F.when(n % 3 == 0, F.concat(F.slice(lines, 2, F.size(lines)), F.slice(lines, 1, 1))).otherwise(lines)
    edited = F.flatten(F.transform(turned, lambda x, i: F.when(i % 4 == 3, F.array().cast("array<string>")).when(i % 5 == 2, F.array(x, x)).otherwise(F.array(x))))
    path = F.concat(F.lit("d"), n.cast("string"), F.lit(".md")).alias("path")
    named = lambda c: F.concat(F.lit(c), (n * 2).cast("string"))
    old = docs.filter("doc_id % 6 <> 1").select(named("b").alias("commit"), path, "text")
    new = docs.filter("doc_id % 6 <> 2").select(named("c").alias("commit"), path, F.array_join(F.concat(edited, F.array(F.lit("added line"))), "\n").alias("text"))
    return old.unionByName(new), docs.select(named("c").alias("commit"), named("b").alias("parent"))
