"""Readers and writers of session logs, JSON documents and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import snapshots

#: The fields of the history tables.
EXPERIMENT_LOG = (
    "run_id string, ts string, strategy string, target_file string, baseline_commit string, new_commit string, baseline_score double, score_mean double, score_median double, "
    "delta double, decision string, n_replayed long, budget_used_usd double, notes string"
)
DEAD_LETTER = "run_id string, ts string, strategy string, target_file string, reverted_commit string, revert_mode string, reason string"
CORRECTIONS = "ts string, project string, prompt string, root_cause string, supposed_to string, what_i_did string, what_you_said string, proposed_rule string"


def _text(spark: SparkSession, path: str | list[str], wholetext: bool = False) -> DataFrame:
    """path, value and start (the block's first byte) of text files; no row where path names none."""
    nothing = spark.createDataFrame([], "path string, value string, start long")
    if not path:
        return nothing
    try:
        rows = spark.read.text(path, wholetext=wholetext)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return nothing
    return rows.select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_block_start").alias("start"))


def _first_files(spark: SparkSession, pattern: str, most: int) -> list[str]:
    """The first files by path, empty ones too, which no reader of Spark's lists."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    return sorted(status.getPath().toString() for status in found or [])[:most]


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files in their order: path, ord, line. Blank lines are left out; an absent path has none.

    A large file is read in blocks by many tasks. ord rises along a file but has gaps: it is the
    block's first byte plus the line's number in its task, and no block has more lines than bytes.
    """
    lines = _text(spark, path).withColumn("ord", F.col("start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return lines.filter(F.col("value").rlike(r"(?U)\S")).select("path", "ord", F.col("value").alias("line"))


def read_variants(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines as path, ord, v; lines that do not parse are left out."""
    return read_lines(spark, path).select("path", "ord", F.try_parse_json("line").alias("v")).filter("v is not null")


def read_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines of a known schema with ord; malformed lines are left out, missing fields are null."""
    parsed = read_lines(spark, path).select("ord", F.try_parse_json("line").alias("v"), F.from_json("line", schema).alias("row")).filter("v is not null and row is not null")
    return parsed.select("ord", "row.*")


def _timed(rows: DataFrame) -> DataFrame:
    """rows with the text ts read as a time; null where it is none."""
    return rows.withColumn("ts", F.col("ts").try_cast("timestamp"))


def read_experiment_log(spark: SparkSession, path: str) -> DataFrame:
    """Runs in the order of the log."""
    return _timed(read_rows(spark, path, EXPERIMENT_LOG))


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return _timed(read_rows(spark, path, DEAD_LETTER))


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Corrections with a time that can be read; others are left out."""
    return _timed(read_rows(spark, path, CORRECTIONS)).filter("ts is not null")


def read_sessions(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """Messages of `<root>/<directory>/<session>.jsonl`: session_id, directory, ord, ts_raw, ts, type, content, tokens.

    most keeps that many sessions, first by path; empty files count.
    """
    pattern = f"{root}/*/*.jsonl"
    rows = read_variants(spark, pattern if most is None else _first_files(spark, pattern, most))
    get = lambda p, kind: F.try_variant_get("v", p, kind)
    return rows.select(
        F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("session_id"),
        F.regexp_extract("path", r"([^/]+)/[^/]+\.jsonl$", 1).alias("directory"),
        "ord",
        get("$.timestamp", "string").alias("ts_raw"),
        get("$.timestamp", "string").try_cast("timestamp").alias("ts"),
        get("$.type", "string").alias("type"),
        get("$.message.content", "variant").alias("content"),
        F.coalesce(get("$.message.usage.output_tokens", "long"), F.lit(0)).alias("tokens"),
    ).filter(F.col("type").isin("user", "assistant"))


def content_text(content: Column) -> Column:
    """Text of a message: the string itself, or the text parts joined by line ends; null if there is none."""
    parts = F.try_variant_get(content, "$", "array<variant>")
    texts = F.filter(F.transform(parts, lambda p: F.when(F.try_variant_get(p, "$.type", "string") == "text", F.try_variant_get(p, "$.text", "string"))), lambda t: t.isNotNull())
    return F.when(F.schema_of_variant(content) == "STRING", content.cast("string")).when(F.size(texts) > 0, F.array_join(texts, "\n"))


def messages(sessions: DataFrame, is_prompt, project: Column) -> DataFrame:
    """Sessions as messages for segmentation: a row per text or tool call, in order."""
    from ..functions.config import EDIT_TOOLS

    text = content_text(F.col("content"))
    base = sessions.withColumn("text", text).withColumn("is_prompt", (F.col("type") == "user") & is_prompt(F.col("text")))
    base = base.filter((F.col("type") == "assistant") | F.col("is_prompt"))
    parts = F.when(F.col("type") == "assistant", F.try_variant_get("content", "$", "array<variant>"))
    tools = F.filter(
        F.transform(
            F.coalesce(parts, F.array().cast("array<variant>")),
            lambda p: F.when(
                F.try_variant_get(p, "$.type", "string") == "tool_use",
                F.struct(F.coalesce(F.try_variant_get(p, "$.name", "string"), F.lit("unknown")).alias("name"), F.coalesce(F.try_variant_get(p, "$.input.file_path", "string"), F.try_variant_get(p, "$.input.notebook_path", "string")).alias("file")),
            ),
        ),
        lambda t: t.isNotNull(),
    )
    # the message itself comes first and carries its tokens and text; each tool call follows it
    rows = base.select("*", F.posexplode(F.concat(F.array(F.lit(None).cast("struct<name:string,file:string>")), tools)).alias("at", "call"))
    return rows.select(
        "session_id",
        project.alias("project"),
        (F.col("ord") * 10_000 + F.col("at")).alias("ord"),
        "ts",
        "ts_raw",
        (F.col("is_prompt") & (F.col("at") == 0)).alias("is_prompt"),
        F.when(F.col("is_prompt"), F.col("text")).alias("prompt"),
        F.col("call.name").alias("tool"),
        F.when(F.col("call.name").isin(*EDIT_TOOLS), F.col("call.file")).alias("file"),
        F.when(F.col("at") == 0, F.col("tokens")).otherwise(0).alias("tokens"),
        F.when((F.col("at") == 0) & (F.col("type") == "assistant"), F.coalesce(F.length("text"), F.lit(0))).otherwise(0).alias("text_chars"),
    )


def read_keyed(spark: SparkSession, directory: str, schema: StructType | str) -> DataFrame:
    """One JSON document per file, `<key>.json`: key and its fields; files that do not parse are left out, an absent directory has none."""
    whole = _text(spark, f"{directory}/*.json", wholetext=True)
    rows = whole.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("key"), F.try_parse_json("value").alias("v"), F.from_json("value", schema).alias("row"))
    return rows.filter("v is not null").select("key", "row.*")


def proposals(texts: DataFrame) -> DataFrame:
    """Proposal documents (run_id, value) as run_id, strategy, target_file, score_mean, diff.

    A json fence gives the fields; else bold labels do. Documents with neither strategy nor
    target are left out. The patterns are fixed values: they are the documents' format.
    """
    fence = F.try_parse_json(F.nullif(F.regexp_extract("value", r"(?s)```json\n(.*?)\n```", 1), F.lit("")))
    label = lambda name: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)\*\*{name}:\*\*\s*`?([^`\n]+?)`?\s*$", 1)), F.lit(""))
    number = F.regexp_extract("value", r"\*\*(?:Dry-run score|Score):\*\*\s*([\d.]+)", 1).try_cast("double")
    out = texts.withColumn("_f", fence)
    pick = lambda path, kind, other: F.when(F.col("_f").isNotNull(), F.try_variant_get("_f", path, kind)).otherwise(other)
    out = out.select(
        "run_id",
        pick("$.strategy", "string", label("Strategy")).alias("strategy"),
        pick("$.target_file", "string", label("Target")).alias("target_file"),
        pick("$.score_mean", "double", number).alias("score_mean"),
        F.nullif(F.regexp_extract("value", r"(?s)```diff\n(.*?)\n```", 1), F.lit("")).alias("diff"),
    )
    return out.filter((F.coalesce("strategy", F.lit("")) != "") | (F.coalesce("target_file", F.lit("")) != ""))


def write_snapshot(rows: DataFrame, path: str, as_of: str) -> None:
    """Rows as the snapshot of a day, in place of one of the same day; readers see all of it or none."""
    snapshots.commit(rows, path, as_of)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot, by its day."""
    days = snapshots.parts(spark, path)
    if not days:
        raise FileNotFoundError(f"no snapshot in {path}")
    return snapshots.read(spark, path, max(days))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_responses(rows: DataFrame, path: str, run_id: str) -> None:
    """Responses of a run as one part of the responses table; a run written again is replaced."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def last_row(rows: DataFrame, order: str = "ord") -> DataFrame:
    """The last row of a log."""
    return rows.orderBy(F.desc(order)).limit(1)


def last_line(spark: SparkSession, path: str, block: int = 1 << 16) -> DataFrame:
    """The last line of one log that is not blank, as `line`; no row where there is none, or no file.

    Blocks are read from the end backward, twice as many each time, until they hold a line end
    before that line: what is read is in proportion to the line and the blanks after it, not to the log.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    line = None
    if fs.exists(at):
        end = fs.getFileStatus(at).getLen()
        stream = fs.open(at)
        try:
            size = block
            while line is None:
                start = max(0, end - size)
                stream.seek(start)
                kept = bytes(stream.readNBytes(min(size, end))).rstrip()
                if start == 0 or b"\n" in kept:
                    line = kept.rsplit(b"\n", 1)[-1].strip().decode(errors="replace")
                size *= 2
        finally:
            stream.close()
    return spark.createDataFrame([(line,)] if line else [], "line string")


def last_logged(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The last line of one log as a row of its schema; no row where it cannot be read."""
    parsed = last_line(spark, path).select(F.try_parse_json("line").alias("v"), F.from_json("line", schema).alias("row"))
    return parsed.filter("v is not null and row is not null").select("row.*")
