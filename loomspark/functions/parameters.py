"""Scoring functions and word lists as tables and SQL, so that they change without code.

A list is a table with a column `value`. Its rows are gathered in one row, whose size is checked, and sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C

#: Rows that a list has at most.
MOST = 10_000

FUNCTIONS = {
    "cost_ratio": "(run DOUBLE, truth DOUBLE) RETURNS DOUBLE RETURN CASE WHEN coalesce(run, 0) = 0 THEN 0D ELSE greatest(0D, least(1D, 2D - run / coalesce(nullif(truth, 0), 1))) END",
    "tool_alignment": """(run DOUBLE, truth DOUBLE) RETURNS DOUBLE RETURN CASE
      WHEN coalesce(run, 0) = 0 THEN 0D
      WHEN run / coalesce(nullif(truth, 0), 1) < 0.5D THEN run / coalesce(nullif(truth, 0), 1) / 0.5D
      WHEN run / coalesce(nullif(truth, 0), 1) <= 2 THEN 1D
      ELSE greatest(0D, 1 - (run / coalesce(nullif(truth, 0), 1) - 2) / 4) END""",
}


def register(spark: SparkSession) -> None:
    """cost_ratio and tool_alignment as functions of SQL in this session."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def default_lists(spark: SparkSession) -> dict[str, DataFrame]:
    """The lists as they are without a table of one's own."""
    return {name: spark.createDataFrame([(v,) for v in values], "value string") for name, values in (("phrases", C.PHRASES), ("patterns", C.OPTION_PATTERNS))}


def _gathered(table: DataFrame, name: str) -> DataFrame:
    values = F.array_sort(F.collect_list("value"))
    few = F.when(F.size(values) <= MOST, values).otherwise(F.raise_error(F.lit(f"a list has more than {MOST} rows")))
    return F.broadcast(table.filter(F.coalesce("value", F.lit("")) != "").limit(MOST + 1).agg(few.alias(name)))  # one row


def with_phrase_count(texts: DataFrame, phrases: DataFrame, text_col: str = "text", name: str = "n_phrases") -> DataFrame:
    """texts with how often phrases of the list occur, in any case and without overlap; a null text has none counted: null."""
    low = F.lower(text_col)
    found = F.transform("_phrases", lambda p: ((F.length(low) - F.length(F.replace(low, F.lower(p), F.lit("")))) / F.length(p)).cast("long"))
    return texts.crossJoin(_gathered(phrases, "_phrases")).withColumn(name, F.aggregate(found, F.lit(0).cast("long"), lambda a, n: a + n)).drop("_phrases")


def with_pattern_count(texts: DataFrame, patterns: DataFrame, text_col: str = "text", name: str = "n_options") -> DataFrame:
    """texts with how many patterns of the list they match, in any case; null for a null text."""
    hit = F.transform("_patterns", lambda p: F.regexp_like(F.col(text_col), F.concat(F.lit("(?idU)"), p)).cast("long"))
    return texts.crossJoin(_gathered(patterns, "_patterns")).withColumn(name, F.aggregate(hit, F.lit(0).cast("long"), lambda a, n: a + n)).drop("_patterns")
