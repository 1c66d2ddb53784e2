"""Exact rounding, lists and functions as tables and SQL, the end of a log, and git as a source."""

import os
import random
import struct
import subprocess

import pytest
from pyspark.sql import functions as F

from loomspark.functions import parameters as P
from loomspark.functions import text as X
from loomspark.functions.rounding import round_exact
from loomspark.operators import diffstat
from loomspark.sources import gitdata, logs


def bits(x):
    return struct.pack(">d", x)


def test_rounding_is_bit_equal(spark):
    draw = random.Random(1)
    values = [0.0, -0.0, 2.675, -2.675, 0.5, 1.5, 2.5, -0.5, 1e-320, 5e-5, 0.00005, 1e15 + 0.5, 2**52 - 0.5, 2.0**52, 2.0**53, -(2.0**60), 9.1e11 + 0.00005, float("inf"), float("-inf"), 0.1, 1e300, 0.99995, 0.999949999999]
    values += [draw.randrange(10**7) / 10 ** draw.randrange(1, 8) for _ in range(250_000)]  # many lie at or beside a half
    values += [draw.choice([-1, 1]) * draw.random() * 10 ** draw.randrange(-9, 16) for _ in range(400_000)]
    values += [draw.randrange(1 << 20) / (1 << draw.randrange(1, 20)) for _ in range(100_000)]  # exact halves among them
    values += [v for v in (struct.unpack(">d", draw.randbytes(8))[0] for _ in range(250_000)) if v == v]
    df = spark.createDataFrame(__import__("pandas").DataFrame({"x": values}))
    got = df.select("x", *[round_exact(F.col("x"), n).alias(f"r{n}") for n in range(5)]).toPandas()
    assert len(got) > 990_000
    for n in range(5):
        wrong = [(x, r, round(x, n)) for x, r in zip(got.x, got[f"r{n}"]) if abs(x) != float("inf") and bits(r) != bits(round(x, n))]
        assert not wrong, wrong[:5]
    odd = spark.sql("select cast(null as double) x union all select double('nan')").select(round_exact(F.col("x"), 2)).collect()
    assert odd[0][0] is None and odd[1][0] != odd[1][0]


def test_functions_of_sql(spark):
    P.register(spark)
    rows = spark.createDataFrame([(a, b) for a in (None, 0, 1, 2, 3, 7, 40) for b in (None, 0, 1, 4)], "a long, b long")
    for r in rows.select("*", F.expr("cost_ratio(a, b)").alias("c1"), X.cost_ratio(F.col("a"), F.col("b")).alias("c2"), F.expr("tool_alignment(a, b)").alias("t1"), X.tool_alignment(F.col("a"), F.col("b")).alias("t2")).collect():
        assert r.c1 == pytest.approx(r.c2) and r.t1 == pytest.approx(r.t2)


def test_a_changed_list_changes_the_counts(spark, tmp_path):
    texts = spark.createDataFrame([("TLDR: it feels balanced. tldr: new words",), ("",), (None,)], "text string")
    lists = P.default_lists(spark)
    lists["phrases"].write.parquet(str(tmp_path / "phrases"))
    path = str(tmp_path / "phrases")
    count = lambda: [r.n_phrases for r in P.with_phrase_count(texts, spark.read.parquet(path)).collect()]
    assert count() == [3, 0, None]
    assert count() == [r[0] for r in texts.select(X.phrase_count(F.col("text"))).collect()]
    spark.createDataFrame([("New Words",), ("",), (None,)], "value string").write.mode("append").parquet(path)
    spark.catalog.refreshByPath(path)
    assert count() == [4, 0, None]
    options = P.with_pattern_count(texts.union(spark.createDataFrame([("Option a, or here are two ways",)], "text string")), lists["patterns"])
    assert [r.n_options for r in options.collect()] == [0, 0, None, 2]
    with pytest.raises(Exception, match="more than"):
        P.with_phrase_count(texts, spark.range(P.MOST + 5).select(F.col("id").cast("string").alias("value"))).collect()


def test_the_last_line_of_a_long_log(spark, tmp_path, monkeypatch):
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join('{"run_id": "r%d", "ts": "x"}' % i for i in range(200_000)) + "\n\n   \n")
    assert os.path.getsize(path) > 60 * (1 << 16)
    assert logs.last_logged(spark, str(path), logs.EXPERIMENT_LOG).first().run_id == "r199999"
    for text, want in (("", []), ("\n \n", []), ("one", ["one"]), ("one\ntwo\n" + " " * 500 + "\n", ["two"]), ("x" * 3000 + "\n" + "é" * 3000, ["é" * 3000]), ("a\r\nb\r\n", ["b"])):
        path.write_text(text)
        assert [r.line for r in logs.last_line(spark, str(path), block=64).collect()] == want
    assert logs.last_line(spark, str(tmp_path / "none")).collect() == []
    path.write_text('{"run_id": "r"}\n{broken')
    assert logs.last_logged(spark, str(path), logs.EXPERIMENT_LOG).collect() == []


@pytest.fixture
def repository(tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    run = lambda *words: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *words], check=True, capture_output=True)
    run("init", "-q")
    (root / "memory").mkdir()
    (root / "memory" / "a.md").write_text("one\ntwo\n")
    (root / "b c.md").write_text("é\n")
    (root / "raw.bin").write_bytes(b"\xff\x00\xfe")
    run("add", "-A")
    run("commit", "-q", "-m", "1")
    (root / "memory" / "a.md").write_text("two\nthree\nfour\n")
    (root / "b c.md").unlink()
    (root / "memory" / "d.md").write_text("")
    run("add", "-A")
    run("commit", "-q", "-m", "2")
    return str(root)


def test_git_files(spark, repository):
    gitdata.register(spark)
    files = spark.read.format("git_files").option("repository", repository).load()
    first, second = gitdata.git(repository, "rev-list", "--all", "--reverse").split()
    got = {(r.commit, r.path): r.text for r in files.collect()}
    assert got == {(first, "memory/a.md"): "one\ntwo\n", (first, "b c.md"): "é\n", (first, "raw.bin"): None, (second, "memory/a.md"): "two\nthree\nfour\n", (second, "memory/d.md"): "", (second, "raw.bin"): None}
    assert files.rdd.getNumPartitions() == 2
    one = files.filter((F.col("commit") == second) & F.col("path").startswith("memory/"))
    assert sorted(r.path for r in one.collect()) == ["memory/a.md", "memory/d.md"] and one.rdd.getNumPartitions() == 1
    assert files.filter((F.col("commit") == second) & (F.col("path") == "b c.md")).collect() == []
    assert [r.text for r in files.filter(F.col("path").isin("b c.md", "none")).collect()] == ["é\n"]
    assert spark.read.format("git_files").option("repository", repository).option("commits", "HEAD").load().count() == 3


def test_filters_reach_git():
    wanted = gitdata.Wanted()
    assert wanted.take(gitdata.EqualTo(("path",), "a")) and wanted.take(gitdata.In(("path",), ("a", "b"))) and wanted.paths == {"a"}
    assert not wanted.take(gitdata.EqualTo(("text",), "a")) and wanted.has("a") and not wanted.has("b")


def test_diffstat_of_a_repository(spark, repository):
    gitdata.register(spark)
    load = lambda kind: spark.read.format(kind).option("repository", repository).load()
    files = load("git_files").filter("text is not null")
    commits = load("git_commits")
    second = commits.filter("parent is not null").first().commit
    stat = {r.path: (r.added, r.removed) for r in diffstat.diffstat(files, commits).filter(F.col("commit") == second).collect()}
    told = {p: (int(a), int(d)) for a, d, p in (x.split("\t") for x in gitdata.git(repository, "show", "--numstat", "--format=", second).splitlines())}
    assert stat == {p: n for p, n in told.items() if n != (0, 0)} | {"memory/d.md": (0, 0)}
