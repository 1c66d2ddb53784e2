"""Human corrections as labels: matching them to tasks, and scoring responses by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.staging import let, staged

#: Shortest normalized correction that may match by containment.
MIN_CONTAINED = 20
#: Words of a run that containment is looked up by, and characters of a part of a word.
GRAM, PART = 3, 4
#: Texts that may hold a run before a rarer one is looked for.
LIGHT = 64


def last_by_prompt(corrections: DataFrame) -> DataFrame:
    """Of corrections with the same normalized prompt the last; key_ord is the place of the first."""
    norm = corrections.withColumn("np", X.normalize_prompt(F.col("prompt"))).filter("np <> ''")
    row = F.struct(*[F.col(c) for c in corrections.columns if c != "prompt"])
    return norm.groupBy("np").agg(F.max_by(row, "ord").alias("c"), F.min("ord").alias("key_ord"))


def _normalized(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("benchmark_id", X.normalize_prompt(F.col("prompt")).alias("np"))


def _exact(b: DataFrame, c: DataFrame) -> DataFrame:
    return b.join(c.select("np", "key_ord"), "np").select("benchmark_id", "np", "key_ord")


def exact(benchmark: DataFrame, corrections: DataFrame) -> DataFrame:
    """(benchmark_id, np, key_ord) by equal normalized prompts."""
    return _exact(_normalized(benchmark), last_by_prompt(corrections))


def _hashed(w: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(GRAM)])


def _runs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram): the hashed runs of GRAM words of each text, once each."""
    hashed = let(F.split(text, " "), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - GRAM + 1), lambda i: _hashed(w, i))))
    return rows.filter(F.size(F.split(text, " ")) >= GRAM).select(key, F.explode(hashed).alias("gram"))


def _inner_run(text: str) -> Column:
    """The longest run, hashed, of GRAM words between the first and the last, of which there are GRAM + 2 at least: those are whole words of any text around it."""

    def longest(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(2), F.size(w) - GRAM), lambda i: F.struct(F.length(F.array_join(F.slice(w, i, GRAM), " ")).alias("n"), _hashed(w, i).alias("gram")))
        return F.array_max(runs)["gram"]

    return let(F.split(text, " "), longest)


def _inner_runs(text: str) -> Column:
    """All of those runs, once each."""
    return let(F.split(text, " "), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(2), F.size(w) - GRAM), lambda i: _hashed(w, i))))


def _parts(words: DataFrame) -> DataFrame:
    """(word, part): all parts of up to PART characters of each word."""
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(PART)), lambda n: F.substr("word", i, n))))
    return words.select("word", F.explode(F.array_distinct(parts)).alias("part"))


def _by_runs(short: DataFrame, s: str, long: DataFrame, t: str) -> DataFrame:
    """Candidates (s, t): the long texts that hold a run of the short text's.

    Its longest run is looked up. Where more than LIGHT texts hold that one, all its runs are counted, and the
    rarest is taken: a run that many texts share makes no pairs of them. A text of which some run is nowhere has none.
    """
    chosen = staged(short.filter(F.size(F.split(f"{s}_text", " ")) >= GRAM + 2).select(s, _inner_run(f"{s}_text").alias("gram")))
    held = staged(_runs(long, t, f"{t}_text").join(chosen.select("gram").distinct(), "gram", "left_semi"))
    known = staged(chosen.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram"))
    pairs = known.filter(F.col("n") <= LIGHT).join(held, "gram").select(s, t)
    heavy = known.filter(F.col("n") > LIGHT)
    if heavy.isEmpty():
        return pairs
    every = staged(short.join(heavy.select(s), s, "left_semi").select(s, _inner_runs(f"{s}_text").alias("grams")).select(s, F.size("grams").alias("own"), F.explode("grams").alias("gram")))
    among = long.join(held.join(heavy.select("gram").distinct(), "gram", "left_semi").select(t).distinct(), t, "left_semi")
    runs = staged(_runs(among, t, f"{t}_text").join(every.select("gram").distinct(), "gram", "left_semi"))
    counted = every.join(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram")
    rarest = counted.groupBy(s).agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count(F.lit(1)).alias("found"), F.max("own").alias("own")).filter("found = own")
    return pairs.unionByName(rarest.select(s, "gram").join(runs, "gram").select(s, t))


def _by_words(short: DataFrame, s: str, long: DataFrame, t: str) -> DataFrame:
    """Candidates (s, t) for short texts of few words: the long texts that hold, within a word, the one of their words that fewest texts do."""
    few = staged(short.filter((F.col(f"{s}_text") != "") & (F.size(F.split(f"{s}_text", " ")) < GRAM + 2)).select(s, F.explode(F.array_distinct(F.split(f"{s}_text", " "))).alias("within")).filter("within <> ''"))
    if few.isEmpty():
        return few.select(s).join(long.select(t).limit(0))
    postings = staged(long.select(t, F.explode(F.array_distinct(F.split(f"{t}_text", " "))).alias("word")).filter("word <> ''"))
    vocabulary = postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    wanted = few.select("within").distinct().withColumn("part", F.left("within", F.lit(PART)))
    words = staged(_parts(vocabulary).join(wanted, "part").filter(F.contains("word", "within")).select("within", "word").join(vocabulary, "word"))
    best = few.join(words.groupBy("within").agg(F.sum("n").alias("n")), "within", "left").groupBy(s).agg(F.min_by("within", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "within")).alias("within"))
    return best.join(words.select("within", "word"), "within").join(postings, "word").select(s, t).distinct()


def _contained(b: DataFrame, c: DataFrame, min_length: int) -> DataFrame:
    """contained over prompts that are normalized, b's (benchmark_id, np) and c's (np, key_ord)."""
    c = staged(c.filter(F.length("np") >= min_length).select(F.col("key_ord").alias("c"), F.col("np").alias("c_text")))
    tasks = staged(b.select("benchmark_id", F.col("np").alias("b_text")))
    b = staged(tasks.groupBy("b_text").agg(F.min("benchmark_id").alias("b")))  # tasks of one prompt are one text

    def within(short: DataFrame, s: str, long: DataFrame, t: str) -> DataFrame:
        """(s, t) of the texts of short that texts of long contain; what is longer than all of those is in none."""
        longest = long.agg(F.max(F.length(f"{t}_text")).alias("longest"))  # one row
        short = staged(short.crossJoin(F.broadcast(longest)).filter(F.length(f"{s}_text") <= F.col("longest")).drop("longest"))
        pairs = _by_runs(short, s, long, t).unionByName(_by_words(short, s, long, t))
        texts = pairs.join(short, s).join(long, t)
        return texts.filter(F.contains(F.col(f"{t}_text"), F.col(f"{s}_text"))).select("b", "c")

    found = within(c, "c", b, "b").unionByName(within(b, "b", c, "c")).groupBy("b").agg(F.min("c").alias("key_ord"))
    all_of_them = b.filter("b_text = ''").select("b").crossJoin(c.agg(F.min("c").alias("key_ord"))).filter("key_ord is not null")  # one row
    return found.unionByName(all_of_them).join(b, "b").select("b_text", "key_ord").join(tasks, "b_text").select("benchmark_id", F.col("b_text").alias("np"), "key_ord")


def contained(benchmark: DataFrame, corrections: DataFrame, min_length: int = MIN_CONTAINED) -> DataFrame:
    """First correction, of min_length or more, whose normalized prompt contains a task's or is contained in it.

    Containment is looked up, not found by comparing all pairs, and only ids are sent around: where the
    shorter text has a run of GRAM words between its first and last one, the longer text holds that run
    too. A shorter text of few words must have each of its words within a word of the longer
    text; which words of the vocabulary hold it is looked up by parts of PART characters. An
    empty prompt is contained in all. Texts are fetched for the pairs that this leaves. benchmark_id is unique.
    """
    return _contained(_normalized(benchmark), last_by_prompt(corrections), min_length)


def matched(benchmark: DataFrame, corrections: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Exact matches, and for the rest the first by containment: (benchmark_id, np, key_ord, how).

    last is last_by_prompt of the corrections, where it is at hand.
    """
    c = staged((last_by_prompt(corrections) if last is None else last).select("np", "key_ord"))
    b = staged(_normalized(benchmark))
    equal = staged(_exact(b, c))
    rest = b.join(equal.select("benchmark_id"), "benchmark_id", "left_anti")
    return equal.withColumn("how", F.lit("exact")).unionByName(_contained(rest, c, MIN_CONTAINED).withColumn("how", F.lit("contained")))


def label_scores(pairs: DataFrame) -> DataFrame:
    """pairs (response_text, supposed_to, what_i_did) with label_score, four places."""
    return pairs.withColumn("label_score", F.round(X.label_score(F.col("response_text"), X.keywords(F.col("supposed_to")), X.keywords(F.col("what_i_did"))), 4))


def correction_scores(benchmark: DataFrame, corrections: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per replayable task that a correction matches and that has a response: benchmark_id, how, root_cause, label_score.

    benchmark has benchmark_id (unique), prompt, replayable; corrections ord (unique), prompt, root_cause,
    supposed_to, what_i_did; responses benchmark_id, response_text.
    """
    last = staged(last_by_prompt(corrections).select("np", "key_ord", "c.root_cause", "c.supposed_to", "c.what_i_did"))
    pairs = matched(benchmark.filter("replayable").select("benchmark_id", "prompt"), corrections, last).select("benchmark_id", "key_ord", "how")
    return label_scores(pairs.join(last.drop("np"), "key_ord").join(responses.select("benchmark_id", "response_text"), "benchmark_id")).select("benchmark_id", "how", "root_cause", "label_score")


def composite(scores: DataFrame, *keys: str) -> DataFrame:
    """Number of matched tasks and mean label score; the mean is null if there are none."""
    return scores.groupBy(*keys).agg(F.count("label_score").alias("n_matched"), F.round(F.avg("label_score"), 4).alias("corrections_composite"))


def recent(corrections: DataFrame, n: int = 20) -> DataFrame:
    return corrections.orderBy(F.desc("ord")).limit(n)


def shared_causes(corrections: DataFrame, least: int = 2) -> DataFrame:
    return corrections.groupBy("root_cause").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def keep_first(rows: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
