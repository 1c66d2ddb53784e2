"""Toxicity from a weighted lexicon matched by an Aho-Corasick automaton.

Text is folded first: lower case, compatible forms, homoglyphs and digit substitutions to the
letters they stand for, all else between words to one kind of gap. Lexicon entries are words or beginnings of
words. Matches inside an exception phrase do not count. The matched weight, normalised by the
text's length, goes through a logistic curve.

The lexicon's weights and the curve are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

#: Labelled rows that training reads at most, about: those with the smallest hash of their id.
SAMPLE_ROWS = 12_000
#: Lengths of word beginnings that may become entries.
STEMS = range(4, 9)
#: Least log-odds of an entry, two standard errors below its estimate, and least toxic texts with it.
MIN_ODDS, MIN_TEXTS = 1.5, 4

#: Lower-case letters that look like Latin ones (Cyrillic, Greek, Latin), each with the letter it stands for.
HOMOGLYPHS = str.maketrans(
    "авсеёгһіїјкӏмнорѕтухԁԛԝ" "αβγεηικνορτυχω" "ıɑɡℓⱡøđħł",
    "abceerhiijklmhopstyxdqw" "abyenikvoptuxw" "iagllodhl",
)
#: Digits and signs written for letters.
DIGITS = str.maketrans("013457@$", "oieastas")
#: The lexicon where there are no labels to learn one from, and harmless phrases with such words.
SEED_LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting")
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "pond scum")
_GAPS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum() and c not in "@$"} | {c: None for c in "\u00ad\u200b\u200c\u200d\u2060\ufeff"})
#: Whole words with a digit or sign that may stand for a letter.
_DIGIT_WORD = re.compile(r"(?<!\S)[^\s013457@$]*+[013457@$]\S*+")


def _lettered(word: re.Match) -> str:
    return word[0].translate(DIGITS) if any(c.isalpha() for c in word[0]) else word[0]


def fold(text: str) -> str:
    """Folded text, a space before and after it. Digits stand for letters only in words that hold letters."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(HOMOGLYPHS)
    return f" {_DIGIT_WORD.sub(_lettered, text.translate(_GAPS))} "


@dataclass(frozen=True)
class Model:
    entries: tuple[tuple[str, float], ...]  # (" word " or " stem", weight)
    exceptions: tuple[str, ...]
    curve: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)

    def score(self, text: str) -> float:
        x = self.features(text)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(a * b for a, b in zip(self.curve, x, strict=True))))))

    def features(self, text: str) -> tuple[float, ...]:
        """One, the weight of all matches, that weight per word of text, and the number of matches, on flat scales."""
        if not text:
            return (1.0, 0.0, 0.0, 0.0)
        folded = fold(text)
        weight, hits = self._matched(folded)
        words = max(1, folded.count(" ") - 1)
        return (1.0, math.log1p(weight), math.log1p(100 * weight / words), math.log1p(hits))

    def _matched(self, folded: str) -> tuple[float, int]:
        found = list(automaton(self).iter(folded)) if self.entries else []
        if not found:
            return 0.0, 0
        ends: list[int] = []  # of the exception phrases, and below their starts; both rise
        starts: list[int] = []
        for end, (size, weight) in found:
            if weight is None:
                while starts and starts[-1] >= end - size + 1:
                    starts.pop(), ends.pop()
                starts.append(end - size + 1)
                ends.append(end)
        best: dict[int, float] = {}
        for end, (size, weight) in found:
            start = end - size + 1
            if weight is not None and not ((at := bisect_right(starts, start)) and start <= ends[at - 1]):
                best[start] = max(weight, best.get(start, weight))  # of entries that begin one word, the heaviest
        return sum(best.values()), len(best)


@lru_cache(maxsize=4)
def automaton(model: Model) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for entry, weight in model.entries:
        out.add_word(entry, (len(entry), weight))
    for phrase in model.exceptions:
        entry = f" {phrase} "
        out.add_word(entry, (len(entry), None))
    out.make_automaton()
    return out


def _features(text: str) -> set[str]:
    words = set(fold(text).split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for n in STEMS for w in words if len(w) > n}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """A model from labelled rows, at most about sample_rows of them: that bounds the number of entries too.

    Rows with a null id or label are left out; a null text counts as empty. Without labelled
    rows of both kinds the model is the seed lexicon with a fixed curve.
    """
    known = labels.select(labels[id_col].alias("id"), (labels[label_col] > 0).cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    steps = 1 << 20
    most = min(steps, -(-steps * sample_rows // max(1, known.count())))
    sample = F.broadcast(known.filter(F.pmod(F.xxhash64("id"), F.lit(steps)) < most))  # about sample_rows rows
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(sample, "id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        n = [0, 0]
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n[toxic] += 1
                found.update((f, toxic) for f in _features(text or ""))
        keys = list(found)
        yield pa.RecordBatch.from_pydict({"feature": pa.array([k[0] for k in keys] + ["", ""], pa.string()), "toxic": pa.array([k[1] for k in keys] + [0, 1], pa.int32()), "n": pa.array([found[k] for k in keys] + n, pa.int64())})

    counts = rows.mapInArrow(count, "feature string, toxic int, n long").groupBy("feature").agg(
        F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("c")
    )
    counts = staged(counts)
    total = counts.filter("feature = ''").first()
    a_all, c_all = (total["a"], total["c"]) if total else (0, 0)
    if not a_all or not c_all:
        return Model(tuple((f" {w} ", 4.0) for w in sorted(SEED_LEXICON)), exceptions, (-4.0, 1.0, 1.0, 1.0))
    odds = F.log((F.col("a") + 0.5) / (a_all + 1)) - F.log((F.col("c") + 0.5) / (c_all + 1))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("c") + 0.5))
    strong = counts.filter(F.col("feature") != "").filter(F.col("a") >= MIN_TEXTS).withColumn("odds", odds).filter(F.col("odds") - 2 * error >= MIN_ODDS)
    entries = {r["feature"]: r["odds"] for r in strong.collect()}  # no more than the words of the sample
    model = Model(tuple(sorted(entries.items())), exceptions)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [shared.value.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "x": pa.array([list(x) for x in xs], pa.list_(pa.float64()))})

    measured = rows.mapInArrow(measure, "toxic int, x array<double>").collect()  # a few numbers for each row of the sample
    curve = logistic(np.array([r["x"] for r in measured]), np.array([r["toxic"] for r in measured], float))
    return Model(model.entries, exceptions, tuple(float(c) for c in curve))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton's steps, rows in a fixed order of sums."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - ridge * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those in keep) plus score, from 0 to 1.

    A null text counts as empty; empty texts have a score too. The score of a text depends on
    nothing but the text, so repeated rows score alike. A column score of docs is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t or "") for t in batch.column("_loomspark_text").to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {"score": pa.array(scores, pa.float64())})

    source = docs.select(docs[text_col].alias("_loomspark_text"), *[docs[c] for c in kept])
    return source.mapInArrow(score, docs.select(*[docs[c] for c in kept]).schema.add("score", T.DoubleType()))
