"""Language of a text, and of its spans where languages mix.

Every word is scored under each candidate language by its letter trigrams. The script of a
word, told by code-point ranges, narrows the candidates first. Viterbi over the words, with a
penalty for a switch, labels the spans; the text's language is the one with most letters.

Training counts trigrams over a bounded sample of labelled rows per language, so the model is
languages x BUCKETS numbers whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows per language that training counts at most, about: those with the smallest hash of their id.
ROWS_PER_LANGUAGE = 4000
BUCKETS = 1 << 15
#: Log-odds that a switch of language costs.
SWITCH = 12.0
#: A language is a candidate for a script that holds at least this share of its training letters.
MIN_SHARE = 0.01
#: A text is in no known language if a letter of it is so much less likely, in nats, than one of its language's training texts,
#: with more allowed the shorter it is, or if most of its letters are of scripts that no language has.
FAR, FAR_SHORT = 3.0, 100.0
#: Letters handled at once, times languages.
CHUNK = 1 << 20
#: First code points of Unicode's script ranges, in order. 0: any script.
SCRIPTS = (
    (0x0000, 0), (0x0041, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0900, 7),
    (0x0980, 8), (0x0A00, 9), (0x0B80, 10), (0x0C00, 11), (0x0E00, 12), (0x0E80, 0), (0x10A0, 13), (0x1100, 14), (0x1200, 0), (0x1E00, 1),
    (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x3040, 15), (0x3100, 0), (0x3400, 16), (0xA000, 0), (0xAC00, 14), (0xD7B0, 0),
    (0xF900, 16), (0xFB00, 0),
)
N_SCRIPTS = 17


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its lower case, its script."""
    points = range(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in points), bool, len(points))
    lower = np.arange(len(points), dtype=np.uint32)
    for c in np.flatnonzero(letter[:0x20000]):
        small = chr(c).lower()
        if len(small) == 1:
            lower[c] = ord(small)
    script = np.zeros(len(points), np.uint8)
    for (first, name), (after, _) in zip(SCRIPTS, (*SCRIPTS[1:], (len(points), 0)), strict=True):
        script[first:after] = name
    return letter, lower, script


class Words:
    """The words of many texts: runs of letters, with the trigram bucket of each letter."""

    def __init__(self, texts: list[str]):
        letter, lower, script = _tables()
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letter[points]
        folded = np.where(is_letter, lower[points], 0).astype(np.uint64)
        at = np.flatnonzero(is_letter)
        before, after = np.append(np.uint64(0), folded[:-1]), np.append(folded[1:], np.uint64(0))
        mixed = (before[at] * np.uint64(0x9E3779B97F4A7C15)) ^ (folded[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after[at] * np.uint64(0x165667B19E3779F9))
        mixed ^= mixed >> np.uint64(29)
        self.buckets = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 15)).astype(np.int32)
        opens = is_letter.copy()
        opens[1:] &= ~is_letter[:-1]
        self.starts = np.flatnonzero(opens)  # code points
        self.first = np.searchsorted(at, self.starts)  # letters
        self.letters = np.diff(np.append(self.first, len(at)))
        self.scripts = script[points[self.starts]].astype(np.int32)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_at = np.append(0, np.cumsum(lengths))
        self.word_at = np.searchsorted(self.starts, self.text_at)  # the words of text i are word_at[i] to word_at[i + 1]


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: languages x BUCKETS trigrams; scripts: languages x N_SCRIPTS letters."""
        self.languages = languages
        smooth = counts + 0.1
        self.scores = np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32)
        #: mean score of a letter of each language's training texts
        self.means = (counts.T * self.scores).sum(0) / np.maximum(counts.sum(1), 1)
        allowed = scripts >= MIN_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
        allowed[:, 0] = True
        self.foreign = ~allowed.any(0)
        allowed[:, self.foreign] = True  # a script that no language has tells nothing
        self.penalty = np.where(allowed, 0, -1e4).T.astype(np.float32)

    def label(self, texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words of texts, the language of each word, and its score in that language."""
        words = Words(texts)
        if not len(words.starts):
            return words, np.zeros(0, np.uint8), np.zeros(0, np.float32)
        scores = np.add.reduceat(self.scores[words.buckets], words.first, axis=0)
        labels = viterbi(scores + self.penalty[words.scripts], words.word_at)
        return words, labels, scores[np.arange(len(labels)), labels]


def viterbi(scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Best labels of the sequences scores[bounds[i]:bounds[i + 1]]; all sequences advance together."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    live = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # sequences longer than t
    kind = np.uint8 if scores.shape[1] <= 256 else np.uint16
    back = np.zeros(scores.shape, kind)
    own = np.arange(scores.shape[1], dtype=kind)
    best = scores[starts[: live[0]]] if len(live) else scores[:0]
    ends = np.zeros(len(starts), kind)
    for t, n in enumerate(live):
        if t:
            ends[n : len(best)] = best[n:].argmax(1)
            best = best[:n]
            at = starts[:n] + t
            top = best.argmax(1)
            switched = best[np.arange(n), top] - SWITCH
            stays = best >= switched[:, None]
            back[at] = np.where(stays, own, top[:, None])
            best = np.where(stays, best, switched[:, None]) + scores[at]
    ends[: len(best)] = best.argmax(1) if len(best) else 0
    labels = np.zeros(len(scores), kind)
    now = ends
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        labels[at] = now[:n]
        if t:
            now = now.copy()
            now[:n] = back[at, now[:n]]
    return labels


def _chunks(texts: list[str], most: int) -> Iterator[list[int]]:
    """Indexes of texts by length, longest first, in chunks of about so many characters."""
    chunk: list[int] = []
    size = 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if chunk and size + len(texts[i]) > most:
            yield chunk
            chunk, size = [], 0
        chunk.append(i)
        size += len(texts[i]) + 1
    if chunk:
        yield chunk


def train(labelled: DataFrame, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model of the languages in lang_col; None if no row has a language.

    Of each language all rows count, or about per_language of them, picked by a hash of key.
    Rows with a null language are left out; null texts add nothing.
    """
    rows = labelled.select(labelled[key].alias("key"), labelled[text_col].alias("text"), labelled[lang_col].alias("lang")).filter("lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    steps = 1 << 20
    limits = [(lang, i, min(steps, -(-steps * per_language // sizes[lang]))) for i, lang in enumerate(languages)]
    limits = F.broadcast(rows.sparkSession.createDataFrame(limits, "lang string, id int, most long"))
    sample = rows.join(limits, "lang").filter(F.pmod(F.xxhash64("key"), F.lit(steps)) < F.col("most")).select("id", "text")
    n = len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((n, BUCKETS + N_SCRIPTS), np.int64)
        for batch in batches:
            ids, texts = batch.column("id").to_numpy(), [t or "" for t in batch.column("text").to_pylist()]
            for chunk in _chunks(texts, CHUNK):
                words = Words([texts[i] for i in chunk])
                owner = np.repeat(ids[chunk], np.diff(words.word_at))
                np.add.at(found, (owner, BUCKETS + words.scripts), words.letters)
                flat = np.repeat(owner, words.letters).astype(np.int64) * (BUCKETS + N_SCRIPTS) + words.buckets
                found += np.bincount(flat, minlength=found.size).reshape(found.shape)
        own, bucket = np.nonzero(found)
        yield pa.RecordBatch.from_pydict({"id": own.astype(np.int32), "bucket": bucket.astype(np.int32), "n": found[own, bucket]})

    totals = np.zeros((n, BUCKETS + N_SCRIPTS))
    for r in sample.mapInArrow(count, "id int, bucket int, n long").groupBy("id", "bucket").agg(F.sum("n").alias("n")).collect():
        totals[r["id"], r["bucket"]] = r["n"]
    return Model(languages, totals[:, :BUCKETS], totals[:, BUCKETS:])


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text", spans: bool = False, known: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those in keep) plus lang_pred, score, and spans (start, end, lang) and known if asked for.

    score is the share of the text's letters that Viterbi gave to lang_pred. A null text, one
    without a letter, and any text under no model, is `und` with score 0 and no spans. Ties go
    to the language that sorts first. start and end count code points, end exclusive. known is
    false for `und`, for texts mostly in scripts that no language of the model has, and for
    those whose letters are far less likely in lang_pred than those of its training texts (FAR).
    """
    names = ["lang_pred", "score"] + ["spans"] * spans + ["known"] * known
    kept = [docs[c] for c in (docs.columns if keep is None else keep) if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(texts: pa.Array) -> pa.Array:
        model = shared.value
        n = len(model.languages) if model else 1
        texts = [t or "" for t in texts.to_pylist()]
        langs, scores, found, fits = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts], [False] * len(texts)
        for chunk in _chunks(texts, max(1 << 16, CHUNK // n)) if model else ():
            words, labels, own = model.label([texts[i] for i in chunk])
            owner = np.repeat(np.arange(len(chunk)), np.diff(words.word_at))
            letters = np.bincount(owner * n + labels, weights=words.letters, minlength=len(chunk) * n).reshape(-1, n)
            best, total = letters.argmax(1), letters.sum(1)
            if known:
                top = np.bincount(owner * n + labels, weights=own, minlength=len(chunk) * n).reshape(-1, n)[np.arange(len(chunk)), best]
                most = np.maximum(letters[np.arange(len(chunk)), best], 1)
                foreign = np.bincount(owner, weights=words.letters * model.foreign[words.scripts], minlength=len(chunk))
                fit = (top / most >= model.means[best] - FAR - FAR_SHORT / most) & (2 * foreign <= total)
            for j, i in enumerate(chunk):
                if total[j]:
                    langs[i], scores[i] = model.languages[best[j]], float(letters[j, best[j]] / total[j])
                    if known:
                        fits[i] = bool(fit[j])
                    if spans:
                        found[i] = _spans(words, labels, j, model.languages)
        columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        if spans:
            columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
        if known:
            columns.append(pa.array(fits, pa.bool_()))
        return pa.StructArray.from_arrays(columns, names)

    kinds = "lang_pred string, score double" + ", spans array<struct<start:long,end:long,lang:string>>" * spans + ", known boolean" * known
    # not deterministic to the planner: it must not run the model again for a filter on its result
    udf = F.arrow_udf(label, T.StructType.fromDDL(kinds)).asNondeterministic()
    return docs.select(*kept, udf(docs[text_col]).alias("_loomspark_found")).select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in names], "_loomspark_found.*")


def _spans(words: Words, labels: np.ndarray, text: int, languages: list[str]) -> list[dict]:
    a, b = words.word_at[text], words.word_at[text + 1]
    cuts = np.append(a, np.append(np.flatnonzero(np.diff(labels[a:b])) + a + 1, b))
    base = words.text_at[text]
    return [{"start": int(words.starts[i] - base), "end": int(words.starts[j - 1] + words.letters[j - 1] - base), "lang": languages[labels[i]]} for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))
