"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, toxicity
from .clustering import clustered
from .common import read_table
from .conversations import damaged, repair_report
from .decontaminate import contamination
from .embedding_dups import near_vectors
from .html_extract import extracted
from .jaccard import near_duplicates
from .licenses import license_scan
from .packing import packed
from .quality import judged
from .secrets import counted, secret_spans, shown
from .sharding import shard_by_bytes


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), F.col("doc_id").cast("string"))
    return license_scan(docs.select("doc_id", path.alias("path"), "text"), keep=["doc_id", "path"])


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("fold", langid.fold(F.col("doc_id"), 4))
    model = langid.train(docs.filter("fold <> 2"))
    found = langid.with_language(docs, model, keep=["doc_id", "fold"])
    return found.select("doc_id", (F.col("fold") == 2).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("fold", langid.fold(F.col("doc_id"), 3))
    model = toxicity.train(docs.filter("fold <> 1"), read_table(spark, sf_dir, "labels"))
    found = toxicity.with_toxicity(docs, model, keep=["doc_id", "fold"])
    return found.select("doc_id", (F.col("fold") == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda x: x["kind"] < 3)
    return found.select(
        "doc_id",
        counted(spans, "assign").alias("n_assign"),
        counted(spans, "access").alias("n_access"),
        counted(spans, "hex").alias("n_hex"),
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(spans).alias("spans"),
    )


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(damaged(turns), turns)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(read_table(spark, sf_dir, "embeddings")).drop("measured")


QUERIES = {f.__name__: f for f in (op1_sharding, op2_license_scan, op3_html_extraction, op4_langid, op5_toxicity, op6_decontamination, op7_packing, op8_embedding_dups, op9_ngram_jaccard, op10_secrets, op11_conversations, op12_quality, op13_clustering)}
