"""Documents through five training-data operators, stage by stage.

Each stage reads what the one before it kept, written as Parquet in between. All but the last
keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import langid
from loomspark.llm.common import BATCH_ROWS, read_table, staged
from loomspark.llm.decontaminate import decontaminated
from loomspark.llm.jaccard import near_duplicates
from loomspark.llm.packing import packed
from loomspark.llm.secrets import redacted


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go between Spark and Python; in batches of at most 1,000 rows they take little memory on either side.

    The setting stays lowered in the session: a stage's table is computed when it is written, after the stage returned.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; null texts and texts without a letter go.

    So do texts in scripts that no language of the model has, and texts whose letters are far
    less likely than those of its training texts (langid.FAR). The model is trained on the
    stage's own labelled rows, so on whatever languages they have; without labels nothing is known.
    """
    _small_batches(spark)
    model = langid.train(docs)
    found = langid.with_language(docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]), model, f"c{docs.columns.index('text')}", known=True)
    return found.filter("known").drop("lang_pred", "score", "known").toDF(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the first by id, nulls last, and then by MD5 of the text.

    Rows of equal id and text count as one document: of them the first by the other columns
    stays. Documents without words are near nothing. (id, text) pairs are told apart by 64-bit hashes.
    """
    digest = F.coalesce(F.md5("text"), F.lit(""))
    rows = docs.select("doc_id", "text", digest.alias("digest"), F.xxhash64("doc_id", digest).alias("row"))
    pairs = rows.groupBy("row", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    groups = near_duplicates(rows.select("row", "text"), id_col="row").select(F.col("doc_id").alias("row"), "component_id").distinct()
    first = pairs.join(groups, "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "n")).alias("first"))
    kept = staged(first.select("first.doc_id", "first.digest", "first.n"))

    def held(condition: str) -> DataFrame:
        chosen = kept.filter(condition).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        return docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (digest == F.col("_digest")), "left_semi")

    repeated = held("n > 1").groupBy("doc_id", digest.alias("_digest")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return held("n = 1").unionByName(repeated.select("_row.*"))


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: one that holds a whole window of ten words goes."""
    _small_batches(spark)
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows the text."""
    return redacted(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences of 1024 tokens."""
    _small_batches(spark)
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", keep_one_of_each),
    ("decontamination", remove_benchmarks),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]
#: Viterbi, tokenization and best-fit placement are not SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
