"""The pipeline's stages on a small table, and every registered query on the smallest tables."""

import pytest

import __spark_entry__
import corpus_pipeline
from loomspark.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def docs(spark):
    from pyspark.sql import functions as F

    long = "the cat sat on the mat and then it ran to the old house by the sea where we live now"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, long), (2, long), (3, long + " today"), (4, None), (5, "123"), (6, item), (7, 'my token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ok'), (1, long), (None, "a text without any id")]
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))


def test_stages(spark, docs):
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert kept.columns == COLUMNS and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "3", "6", "7", "None"]
    kept = corpus_pipeline.keep_one_of_each(spark, kept, SF)
    assert kept.columns == COLUMNS and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "6", "7", "None"]
    kept = corpus_pipeline.remove_benchmarks(spark, kept, SF)
    assert kept.columns == COLUMNS and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "7", "None"]
    kept = corpus_pipeline.mask_secrets(spark, kept, SF)
    texts = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert kept.columns == COLUMNS and texts[7] == ("my [SECRET]\" ok", 15)
    pieces = corpus_pipeline.pack_sequences(spark, kept, SF)
    assert {str(r.doc_id) for r in pieces.collect()} == {"1", "7", "None"}


def test_unknown_languages_go(spark):
    good = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = ["Привет мир, как дела", "中文文本测试这里有一些字", "qzx wvkjq xzzq jqv kwxq zzxj vqk qxw jzk xvq wqz kjx " * 4, "bu çok basit bir cümledir ve kimse daha önce yazmadı"]
    more = spark.createDataFrame([(10_000_000 + i, t, None, "s", len(t)) for i, t in enumerate(foreign)], good.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, good.unionByName(more), SF).collect()}
    assert not {i for i in kept if i >= 10_000_000}
    assert kept == {r.doc_id for r in good.collect() if r.text and any(c.isalpha() for c in r.text)}


def test_one_of_each_by_a_total_order(spark):
    long = "the cat sat on the mat and then it ran to the old house by the sea where we live now"
    other = "a quite different text about the hills and the birds that sing there in the morning sun"
    rows = [(1, long, "en", "b", 1), (1, other, "en", "s", 1), (2, long + " today", "en", "s", 1), (None, long, "en", "s", 1), (None, "words of no other text at all", None, "s", 1), (1, long, "en", "a", 1), (3, None, "en", "s", 1), (4, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text, r.source) for r in corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()), key=str)
    assert kept == sorted([(1, long, "a"), (1, other, "s"), (None, "words of no other text at all", "s"), (3, None, "s"), (4, None, "s")], key=str)


def test_stages_on_nothing(spark, docs):
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_returns_every_row(spark, name):
    table, key = {"op3": ("pages", "page_id"), "op8": ("embeddings", "vec_id"), "op11": ("conversations", "conv_id"), "op13": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    out = queries.QUERIES[name](spark, SF)
    assert out.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count()
