"""Quality rules of documents, and verdicts on their hosts.

A document fails a rule by counts over its whole text. Failures are summed by host, and a host's
rate of each rule is shrunk towards the rate of all hosts by a beta prior fitted to them (method
of moments): a host of few documents is judged mostly by the prior, one of many by its own. A
host whose shrunk rate reaches a rule's limit is rejected, and all its documents with it.

Only DataFrame functions: words, windows and lines are arrays within a row, and no text is
shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, let, staged

#: White space of the rules, and the characters that count as symbols.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Words in a window of which repeats are looked for.
WINDOW = 5
#: A host is rejected when at least this part of its documents, after shrinkage, fails the rule.
LIMITS = {"short": 0.5, "repeats": 0.5, "symbols": 0.5, "lines": 0.5, "letters": 0.5}
#: Documents that the prior weighs at least: one failure of a host's only document does not decide.
LEAST_WEIGHT = 2.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words_of(text: Column) -> Column:
    bare = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _covered(hashes: Column, size: int) -> Column:
    """How many words lie in a window whose hash is found twice or more; hashes has one for each window in order."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twin = lambda i: F.coalesce(F.get(s, i)["h"], F.lit(None))
        found = F.filter(s, lambda x, i: (F.coalesce(x["h"] == twin(i - 1), F.lit(False))) | (F.coalesce(x["h"] == twin(i + 1), F.lit(False))))
        return F.array_sort(F.transform(found, lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(placed, starts), total)


def repeat_words(words: Column, size: int = WINDOW) -> Column:
    """Words in windows of size words that occur twice or more among words, their first occurrence included.

    Windows are told apart by 64-bit hashes within one text.
    """

    def of_windows(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h, size))

    def of_words(w: Column) -> Column:
        last = F.size(w) - size
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return F.when(last < 1, F.lit(0).cast("long")).otherwise(let(hashes, of_windows))

    return let(words, of_words)


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts of COUNTS in place of the text; a null text has none of anything."""
    text = F.coalesce(docs[text_col], F.lit(""))
    words = words_of(text)
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SPACE) != "")
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    added = {
        "_words": counted, "_lines": by_line,
        "word_chars": F.length(_without(text, SPACE)).cast("long"),
        "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
    }
    out = docs.select(*[docs[c] for c in docs.columns if c != text_col and c not in (*added, *COUNTS)], *[c.alias(n) for n, c in added.items()])
    return out.withColumns({"n_words": F.col("_words.n"), "n_repeat_words": F.col("_words.r"), "n_lines": F.col("_lines.n"), "n_dup_lines": F.col("_lines.d")}).drop("_words", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def failures() -> dict[str, Column]:
    """The rules whose failures count for a host: few words, repeated passages, symbols, repeated lines, mostly single letters."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "short": n < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 100 * F.col("n_symbols") > 20 * chars,
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "letters": chars < 2 * n,
    }


def prior(hosts: DataFrame, rules: list[str]) -> DataFrame:
    """One row: for each rule its rate over all documents (mean_) and the prior's weight in documents (weight_, null: hosts do not differ).

    The spread of the hosts' rates beyond what chance gives is the beta-binomial moment estimate
    of their correlation; weight is 1 / correlation - 1, but LEAST_WEIGHT at least. Sums are decimals, the same in any order.
    """
    n = F.col("n_docs")
    exact = lambda c: F.sum(c.cast("decimal(38,12)"))
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum((n * n).cast("decimal(38,0)")).cast("double").alias("nn"), *[F.sum(f"f_{r}").alias(f"f_{r}") for r in rules], *[exact(F.col(f"f_{r}") * F.col(f"f_{r}") / n).cast("double").alias(f"s_{r}") for r in rules])
    out = {}
    for r in rules:
        mean = F.col(f"f_{r}") / F.col("n")
        chance = mean * (1 - mean)
        spread = F.col(f"s_{r}") - F.col("n") * mean * mean
        room = chance * (F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1))
        alike = (spread - chance * (F.col("k") - 1)) / F.when(room > 0, room)
        out[f"mean_{r}"] = mean
        out[f"weight_{r}"] = F.when(alike > 0, F.greatest(1 / alike - 1, F.lit(LEAST_WEIGHT)))
    return sums.select(*[c.alias(n) for n, c in out.items()])


def host_verdicts(counted: DataFrame, host_col: str = "host", limits: dict[str, float] | None = None) -> DataFrame:
    """host, n_docs, rate_ of each rule after shrinkage, rejected; documents without a host count for none."""
    limits = LIMITS if limits is None else limits
    rules = list(limits)
    rule = failures()
    hosts = staged(counted.filter(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(rule[r]).alias(f"f_{r}") for r in rules]))
    known = hosts.crossJoin(F.broadcast(prior(hosts, rules)))  # one row
    rates = {f"rate_{r}": F.coalesce((F.col(f"f_{r}") + F.col(f"mean_{r}") * F.col(f"weight_{r}")) / (F.col("n_docs") + F.col(f"weight_{r}")), F.col(f"mean_{r}")) for r in rules}
    known = known.withColumns(rates)
    return known.select("host", "n_docs", *rates, reduce(or_, [F.col(f"rate_{r}") >= limits[r] for r in rules]).alias("rejected"))


def judged(docs: DataFrame, text_col: str = "text", host_col: str = "source", limits: dict[str, float] | None = None) -> DataFrame:
    """docs without the text, with the counts of COUNTS, base_failed, host_rejected and kept.

    kept is false if the document fails a base rule or its host is rejected. A null or empty text
    has no word and fails; a document of null host has no host verdict. Repeated rows count as
    documents of their own. Columns of these names, or that begin with _loomspark, are replaced.
    An empty table gives an empty result.
    """
    named = docs.withColumn("_loomspark_host", F.col(host_col).cast("string"))
    counted = staged(with_counts(named, text_col))
    verdicts = host_verdicts(counted, "_loomspark_host", limits).select(F.col("host").alias("_loomspark_host"), F.col("n_docs").alias("_loomspark_n"), F.col("rejected").alias("host_rejected"))
    out = joined(counted.drop("host_rejected", "base_failed", "kept"), verdicts, "_loomspark_host", "_loomspark_n").drop("_loomspark_host")
    failed = base_failed()
    return out.withColumns({"base_failed": failed, "host_rejected": F.coalesce("host_rejected", F.lit(False))}).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
