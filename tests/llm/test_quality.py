import random
import re
from collections import Counter

from pyspark.sql import functions as F

from loomspark.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n_of = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n_of[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(lines), len(hit)


def plain_rules(c):
    n, chars, symbols, dup, lines, repeats = c
    return {"short": n < 10, "repeats": 100 * repeats > 20 * n, "symbols": 100 * symbols > 20 * chars, "lines": 100 * dup > 30 * lines, "letters": chars < 2 * n}


def plain_rejected(rows, limits):
    """Hosts by moment estimates, worked out one by one."""
    fails, size = {}, Counter(h for h, _ in rows if h is not None)
    for h, text in rows:
        for r, bad in plain_rules(plain_counts(text)).items():
            fails[h, r] = fails.get((h, r), 0) + bad
    n, k, out = sum(size.values()), len(size), set()
    for r in limits:
        mean = sum(fails[h, r] for h in size) / n
        chance = mean * (1 - mean)
        spread = sum(m * (fails[h, r] / m - mean) ** 2 for h, m in size.items())
        room = chance * (n - sum(m * m for m in size.values()) / n - (k - 1))
        alike = (spread - chance * (k - 1)) / room if room > 1e-12 else 0
        for h, m in size.items():
            weight = max(1 / alike - 1, 2) if alike > 1e-9 else None
            rate = mean if weight is None else (fails[h, r] + mean * weight) / (m + weight)
            if rate >= limits[r]:
                out.add(h)
    return out


def texts(seed, n=120):
    draw = random.Random(seed)
    vocabulary = ["a", "bb", "c#", "ééé", "d d", "long" * 9, "x", "y"]
    for _ in range(n):
        yield "".join(draw.choice(vocabulary[: draw.choice([2, 8])]) + draw.choice([" ", "  ", "\n", "\t", "\x0b", " "]) for _ in range(draw.choice([0, 1, 5, 9, 30, 200])))


EDGES = [None, "", " \n\t ", "\n\n", "a", "a b c d e", "a b c d e a b c d e", "a a a a a a", "one\none\n one\n\none", "#" * 50, "word " * 9, "　 wide x", "x\r\nx\r\ny", "💡 a\n💡 a\n💡 a"]


def test_counts(spark):
    rows = list(enumerate([*EDGES, *texts(1)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("mine"))
    got = {r.doc_id: tuple(r[c] for c in Q.COUNTS) for r in Q.with_counts(df).collect()}
    for i, text in rows:
        n, chars, symbols, dup, lines, repeats = plain_counts(text)
        assert got[i] == (n, chars, symbols, dup, lines, repeats), (i, text)


def hosts(seed):
    draw = random.Random(seed)
    rows = [("good", "every word here is a new one so nothing at all repeats " + str(i)) for i in range(60)]
    rows += [("bad", "spam spam") for _ in range(50)] + [("bad", rows[i][1]) for i in range(3)]
    rows += [(f"h{i % 15}", draw.choice(["too few words", rows[i][1], rows[i][1], rows[i][1]])) for i in range(60)]
    rows += [("once", "too short")] + [(None, "too short"), (None, rows[0][1])] * 4
    return rows


def test_hosts_are_judged_by_shrunk_rates(spark):
    rows = hosts(3)
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string").repartition(5)
    out = {r.doc_id: r for r in Q.judged(df).collect()}
    rejected = plain_rejected(rows, Q.LIMITS)
    assert "bad" in rejected and "good" not in rejected
    for i, (h, text) in enumerate(rows):
        c = plain_counts(text)
        failed = c[0] < 10 or 100 * c[5] > 20 * c[0]
        assert (out[i].base_failed, out[i].host_rejected, out[i].kept) == (failed, h in rejected, not failed and h not in rejected)
    clean = [i for i, (h, t) in enumerate(rows) if h == "bad" and len(t) > 20]
    assert clean and not any(out[i].kept for i in clean)  # the verdict on the host reaches its clean documents


def test_a_lone_document_is_judged_by_the_prior(spark):
    """One failure of one document does not make a bad host, many failures of many do."""
    rows = [(f"clean{i}", "w" + " w".join(map(str, range(20)))) for i in range(200)] + [("lone", "x")] + [("farm", "x")] * 30
    df = spark.createDataFrame(rows, "source string, text string")
    verdict = {r.host: r for r in Q.host_verdicts(Q.with_counts(df), "source").collect()}
    assert verdict["farm"].rejected and verdict["farm"].rate_short > verdict["lone"].rate_short
    assert not verdict["lone"].rejected and not verdict["clean1"].rejected


def test_hot_host_and_no_spread(spark):
    """All documents of one host: no other rates to shrink towards, so its own rate counts."""
    df = spark.createDataFrame([("only", "x")] * 3 + [("only", " ".join(f"w{i}" for i in range(30)))] * 5, "source string, text string")
    assert {(r.kept, r.base_failed) for r in Q.judged(df).collect()} == {(False, True), (True, False)}


def test_empty_nulls_and_names(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert Q.judged(empty).collect() == []
    df = spark.createDataFrame([(None, None, None, 1), (None, None, None, 1)], "doc_id long, source string, text string, kept int")
    assert [(r.n_words, r.kept, r.base_failed) for r in Q.judged(df).collect()] == [(0, False, True)] * 2


def test_very_long_text_stays_linear(spark):
    import time

    text = " ".join(f"w{i % 50021}" for i in range(250_000))
    df = spark.createDataFrame([(1, "s", text), (2, "s", "same five words come again " * 40_000)], "doc_id long, source string, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in Q.judged(df).collect()}
    assert got[1].n_repeat_words == 250_000 and got[2].n_repeat_words == 200_000 and time.monotonic() - began < 60


def test_no_python_worker(spark):
    plan = Q.judged(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
