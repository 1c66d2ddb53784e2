"""Tables kept up to date by a stream: every batch's changes are one part, written again if the batch is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import config as C
from ..operators import history
from ..sources import snapshots

#: The part of what compact has merged; it sorts before all batches.
MERGED = "0-merged"


def _name(batch: int) -> str:
    return f"1-{batch:015d}"


def save(changes: DataFrame, root: str, batch: int) -> None:
    """Commit a batch's changes as the part of its number: a batch that runs again replaces its part, and one that compact has merged is left alone."""
    merged = [n for n in snapshots.parts(changes.sparkSession, root) if n.startswith(MERGED)]
    if merged and batch <= int(merged[0].rsplit("-", 1)[1]):
        return
    snapshots.commit(changes.withColumn("_batch", F.lit(batch).cast("long")), root, _name(batch))


def _latest(rows: DataFrame, keys: Sequence[str], order: str | None) -> DataFrame:
    rank = F.struct(*([order] if order else []), "_batch")
    held = rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.max_by(F.struct(*rows.columns), rank).alias("r"))
    return held.select("r.*")


def current(spark: SparkSession, root: str, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """The row of each key as it stands: of the highest order, or of the last batch that changed it. Keys may be null."""
    rows = snapshots.read(spark, root)
    if rows is None:
        raise FileNotFoundError(f"no batch committed in {root}")
    return _latest(rows, keys, order).drop("_batch")


def compact(spark: SparkSession, root: str, keys: Sequence[str], order: str | None = None) -> None:
    """Merge all committed batches into one part; the stream may go on meanwhile only if it is this one's process."""
    names = sorted(snapshots.parts(spark, root))
    batches = [int(n.split("-")[1]) for n in names if n.startswith("1-")]
    if batches:
        name = f"{MERGED}-{max(batches):015d}"
        rows = _latest(snapshots.read(spark, root), keys, order)
        path = f"data/compact-{max(batches)}-{len(names)}"
        rows.write.mode("overwrite").parquet(f"{root}/{path}")
        snapshots.publish(spark, root, lambda now: {n: p for n, p in now.items() if n not in names} | {name: path})


def keep(changes: DataFrame, root: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Run a stream of changed rows into the table of root until no input is left; started again it goes on from the checkpoint."""
    return changes.writeStream.foreachBatch(lambda rows, batch: save(rows, root, batch)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def strategy_changes(log: DataFrame) -> DataFrame:
    """strategy_stats over a stream of log rows: the state of each strategy that a batch changes."""
    return history.strategy_stats(log)


def baseline_changes(log: DataFrame) -> DataFrame:
    """latest_baseline over a stream of log rows, with key, of which there is one."""
    row = F.struct("run_id", "decision", "score_mean")
    last = log.filter(F.col("decision").isin(*C.KEPT)).groupBy(F.lit("baseline").alias("key")).agg(F.max_by(row, "ord").alias("b"))
    return last.select("key", F.col("b.run_id").alias("baseline_run"), F.col("b.score_mean").alias("baseline_score"))
