"""Benchmark passages in training text, found by a generalised suffix automaton.

The automaton holds the word sequences of all test items. A document streams through it; at
each word the automaton gives the longest suffix that occurs in an item. Where that match is
at least a window long, the window's words are hit. An item shorter than a window counts as
one window by itself.

Items are cut into blocks of a bounded number of words, each with its automaton. One block, the
usual case, is one pass. More are passes one after another over the texts: a pass holds one automaton
and writes what it found in the texts that were hit, keyed by their MD5, so a larger benchmark
costs time, not memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joined, staged

#: The words of lower-cased text. In UTF-8 these are runs of a-z, 0-9 and bytes over 127.
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Words of benchmark text per automaton, about: it holds at most two states a word.
BLOCK_WORDS = 200_000


def words_of(text: str | bytes | None) -> list[bytes]:
    """The lower-cased words of a text or of its UTF-8 bytes."""
    return (text.encode() if isinstance(text, str) else text).translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over the words of many items, with marks for their windows."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        marks: dict[int, dict[int, set[str]]] = {}
        for name, words in items:
            size = min(window, len(words))
            state = matched = 0
            for word in words:
                state, matched = self.step(state, matched, word)
                if matched >= size:
                    marks.setdefault(self._suffix(state, size), {}).setdefault(size, set()).add(name)
        #: state -> (window size, items) for the windows whose own state it is: one entry for each window of an item
        self.ends: dict[int, list[tuple[int, list[str]]]] = {state: [(size, sorted(names)) for size, names in sorted(own.items())] for state, own in marks.items()}
        #: the nearest state with windows on the way of suffix links, itself included; 0: there is none
        self.marked = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):  # a link leads to a shorter one
            self.marked[state] = state if state in self.ends else self.marked[self.link[state]]

    def _suffix(self, state: int, size: int) -> int:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _add(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, child: int, word: bytes) -> int:
        twin = self._add(self.length[state] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = twin
        while state >= 0 and self.next[state].get(word) == child:
            self.next[state][word] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        new = self._add(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            child = self.next[state][word]
            self.link[new] = child if self.length[child] == self.length[state] + 1 else self._split(state, child, word)
        return new

    def step(self, state: int, matched: int, word: bytes) -> tuple[int, int]:
        while word not in self.next[state]:
            if not state:
                return 0, 0
            state = self.link[state]
            matched = self.length[state]
        return self.next[state][word], matched + 1

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit runs of word positions [start, end) in order and disjoint, and the items found."""
        moves, link, length, ends, marked = self.next, self.link, self.length, self.ends, self.marked
        root = moves[0]
        runs: list[list[int]] = []
        found: set[str] = set()
        state = matched = 0
        here = root
        for at, word in enumerate(words):
            to = here.get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                here = moves[state]
                to = here.get(word)
            if to is None:
                continue
            state = to
            here = moves[to]
            matched += 1
            mark = marked[state]
            while mark:  # at most one for each size of a window
                for size, names in ends[mark]:
                    if size <= matched:
                        found.update(names)
                        start = at + 1 - size
                        while runs and runs[-1][0] >= start:
                            runs.pop()
                        if runs and runs[-1][1] >= start:
                            runs[-1][1] = at + 1
                        else:
                            runs.append([start, at + 1])
                mark = marked[link[mark]]
        return runs, found


def _merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _blocks(items: DataFrame, window: int, id_col: str, text_col: str, block_words: int) -> tuple[int, Iterator]:
    """How many blocks of items there are, and their broadcast automata one by one; null texts and items without words are in none."""
    spark = items.sparkSession
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(_WORDS.pattern))), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_words))

    def built() -> Iterator:
        for block in range(n_blocks):
            own = rows if n_blocks == 1 else rows.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block)
            yield spark.sparkContext.broadcast(SuffixAutomaton(((r["item"], words_of(r["text"])) for r in own.toLocalIterator()), window))

    return n_blocks, built()


def _found_by_text(texts: DataFrame, blocks: Iterator) -> DataFrame:
    """(hash, runs, items, n_rows) of the texts (column text) that were hit, with the runs of all blocks together."""

    def finder(block):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for text in batch.column(0):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    runs, names = block.value.scan(words_of(raw))
                    if runs:
                        rows.append((hashlib.md5(raw).hexdigest(), [x for run in runs for x in run], sorted(names)))
                columns = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.list_(pa.string()))], ["hash", "runs", "items"])

        return find

    found = None
    for block in blocks:
        part = staged(texts.mapInArrow(finder(block), "hash string, runs array<long>, items array<string>"))
        block.destroy()
        part = part.groupBy("hash").agg(F.any_value("runs").alias("runs"), F.any_value("items").alias("items"), F.count(F.lit(1)).alias("n_rows"))
        found = part if found is None else found.unionByName(part)
    merged = F.arrow_udf(_merged_flat, T.ArrayType(T.LongType()))
    lists = found.groupBy("hash").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), F.max("n_rows").alias("n_rows"))  # one of each block at most
    return lists.withColumn("runs", merged("runs"))


def _merged_flat(runs: pa.Array) -> pa.Array:
    pairs = [_merged([[a, b] for a, b in zip(own[::2], own[1::2], strict=True)]) for own in runs.to_pylist()]
    return pa.array([[x for pair in own for x in pair] for own in pairs], pa.list_(pa.int64()))


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_runs array<long>"


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those in keep) plus n_words, n_hit, n_items, items_sha256, contaminated, hit_runs.

    hit_runs are word positions: start, end, start, end ... A null text has no words. Items
    with a null id or text, or without words, match nothing. An item that is there twice
    counts by its id. Repeated documents are each scanned. With no items nothing is hit; an
    empty docs gives an empty result. Columns of docs keep their values, save those that carry
    one of the result's names, which are replaced.
    """
    n_blocks, blocks = _blocks(items, window, item_id, item_text, block_words)
    own = T.StructType.fromDDL(_RESULT)
    # the text goes first, under a name of its own: columns of docs may have any names
    base = docs.select(docs[text_col].alias("_loomspark_text"), *[docs[c] for c in (docs.columns if keep is None else keep) if c not in own.names])
    kept = base.schema.fields[1:]
    if n_blocks == 1:
        return base.mapInArrow(_scanner(next(blocks)), T.StructType([*kept, *own]))
    found = _found_by_text(base.select("_loomspark_text"), blocks)
    counted = staged(base.mapInArrow(_scanner(None), T.StructType([*kept, T.StructField("_loomspark_hash", T.StringType()), T.StructField("n_words", T.LongType())])))
    out = joined(counted, found.select(F.col("hash").alias("_loomspark_hash"), F.col("runs").alias("_loomspark_runs"), F.col("items").alias("_loomspark_items"), F.col("n_rows").alias("_loomspark_n")), "_loomspark_hash", "_loomspark_n")
    runs, names = F.coalesce("_loomspark_runs", F.array().cast("array<long>")), F.coalesce("_loomspark_items", F.array().cast("array<string>"))
    hit = F.aggregate(F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        *[f"`{f.name}`" for f in kept], "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), runs.alias("hit_runs")
    )


def _scanner(block):
    """The result's columns by the one block; without a block the text's hash and number of words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [text.as_buffer().to_pybytes() if text.is_valid else b"" for text in batch.column("_loomspark_text")]
            columns = {n: batch.column(n) for n in batch.schema.names if n != "_loomspark_text"}
            if block is None:
                columns |= {"_loomspark_hash": pa.array([hashlib.md5(raw).hexdigest() for raw in raws], pa.string()), "n_words": pa.array([len(words_of(raw)) for raw in raws], pa.int64())}
            else:
                runs, items, counts = [], [], []
                for raw in raws:
                    words = words_of(raw)
                    found, names = block.value.scan(words)
                    counts.append(len(words))
                    runs.append([x for run in found for x in run])
                    items.append(sorted(names))
                hits = [sum(r[1::2]) - sum(r[::2]) for r in runs]
                columns |= {
                    "n_words": pa.array(counts, pa.int64()),
                    "n_hit": pa.array(hits, pa.int64()),
                    "n_items": pa.array([len(x) for x in items], pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                    "contaminated": pa.array([x > 0 for x in hits], pa.bool_()),
                    "hit_runs": pa.array(runs, pa.list_(pa.int64())),
                }
            yield pa.RecordBatch.from_pydict(columns)

    return scan


def without_spans(text: str, runs: list[int], max_words: int, max_coverage: float) -> str | None:
    """text without the hit runs longer than max_words; null if those cover more than max_coverage of its words."""
    found = [m.span() for m in _WORDS.finditer(text)]
    long = [(a, b) for a, b in zip(runs[::2], runs[1::2], strict=True) if b - a > max_words]
    if sum(b - a for a, b in long) > max_coverage * len(found):
        return None
    out, at = [], 0
    for a, b in long:
        out.append(text[at : found[a][0]])
        at = found[b - 1][1]
    return "".join([*out, text[at:]])


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, max_words: int = 0, max_coverage: float = 0.0, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without benchmark spans, and without documents that those cover beyond max_coverage.

    Only spans of more than max_words words count. With the defaults every document that holds
    a whole window goes; a larger max_coverage cuts the spans out of the text instead. The
    columns are those of docs; null and empty texts stay.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name of docs can clash with ours
    n_blocks, blocks = _blocks(items, window, "item_id", "text", block_words)
    text = F.col(f"c{at}")
    if n_blocks == 1:
        block = next(blocks)

        def scan(texts: pa.Array) -> pa.Array:
            found = [block.value.scan(words_of(t.as_buffer() and t.as_buffer().to_pybytes()))[0] for t in texts]
            return pa.array([[x for run in own for x in run] for own in found], pa.list_(pa.int64()))

        # not deterministic to the planner: it must not scan again for a filter on the runs
        hit = inner.withColumn("_runs", F.arrow_udf(scan, T.ArrayType(T.LongType())).asNondeterministic()(text))
    else:
        found = _found_by_text(inner.select(text), blocks).select(F.col("hash").alias("_hash"), F.col("runs").alias("_found"), "n_rows")
        hit = joined(inner.withColumn("_hash", F.md5(F.coalesce(text, F.lit("")).cast("binary"))), found, "_hash", "n_rows").withColumn("_runs", F.coalesce("_found", F.array().cast("array<long>")))
    runs = F.col("_runs")
    if max_words == 0 and max_coverage == 0:
        return hit.filter(F.size(runs) == 0).select(*inner.columns).toDF(*names)

    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), runs.to_pylist(), strict=True):
            out.append(without_spans(text, own, max_words, max_coverage) if own else text)
        return pa.array(out, pa.string())

    new = F.arrow_udf(cut, T.StringType()).asNondeterministic()
    # only the texts that were hit pass through Python again
    clean = hit.filter(F.size(runs) == 0).select(*inner.columns)
    mended = hit.filter(F.size(runs) > 0).withColumn("_new", new(text, runs)).filter("_new is not null")
    return clean.unionByName(mended.withColumn(f"c{at}", F.col("_new")).select(*inner.columns)).toDF(*names)
