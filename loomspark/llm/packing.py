"""Token sequences of a fixed length, packed online in bounded space.

Every task keeps a fixed number of open windows. A piece goes to the window it fits best;
when none has room, the fullest is topped up with the head of the piece and emitted full, and
the rest is placed again. What is left open at the end of a task is poured together, which
leaves it one window at most; those are merged across tasks by best fit in small groups.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import staged

#: Tasks whose last windows are merged in one group.
MERGED_TASKS = 16
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, added: bool = False):
    """Encoder of a byte-level BPE vocabulary file, whose ids are its merge ranks.

    With added it gives the ids of tokenizers.Tokenizer.from_file(path), about four times as fast;
    without, those of one whose encode_special_tokens is set: added tokens are text like other text.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    tokens = content.get("added_tokens") or []
    special = {t["content"]: t["id"] for t in tokens}
    ranks = {bytes(shown[c] for c in token): i for token, i in content["model"]["vocab"].items() if all(c in shown for c in token) and token != "<|endoftext|>" and token not in special}
    if not added:
        return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if any(t.get(flag) for t in tokens for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"{path}: added tokens that take in or need what is around them are not supported")
    return partial(tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special).encode, allowed_special="all")


class Packer:
    """Open windows of one task. A window is a list of (doc, start, ids, doc_tokens)."""

    def __init__(self, size: int, n_open: int):
        self.size, self.n_open = size, n_open
        self.fills: list[tuple[int, int]] = []  # (fill, window), sorted
        self.windows: dict[int, list] = {}
        self.made = 0

    def place(self, doc, ids: array) -> Iterator[list]:
        """Windows that are full after this document."""
        start, total = 0, len(ids)
        while total - start >= self.size:
            yield [(doc, start, ids[start : start + self.size], total)]
            start += self.size
        while start < total:
            rest = total - start
            at = bisect_left(self.fills, (self.size - rest + 1, -1)) - 1  # the fullest window with room for the rest
            if at < 0 and len(self.windows) < self.n_open:
                self.made += 1
                fill, window = 0, self.made
                self.windows[window] = []
            else:
                fill, window = self.fills.pop(at)  # at -1: none fits, so the fullest of all
            taken = min(rest, self.size - fill)
            self.windows[window].append((doc, start, ids[start : start + taken], total))
            start += taken
            if fill + taken == self.size:
                yield self.windows.pop(window)
            else:
                insort(self.fills, (fill + taken, window))

    def drain(self) -> tuple[list[list], list]:
        """Full windows and a last, partly filled one (or an empty list)."""
        full, last, fill = [], [], 0
        for window in list(self.windows.values()):
            for doc, start, ids, total in window:
                while len(ids):
                    head = ids[: self.size - fill]
                    last.append((doc, start, head, total))
                    ids, start, fill = ids[len(head) :], start + len(head), fill + len(head)
                    if fill == self.size:
                        full.append(last)
                        last, fill = [], 0
        self.windows, self.fills = {}, []
        return full, last


def packed(docs: DataFrame, tokenizer: str, pattern: str, size: int = 1024, n_open: int = 32, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document is the ids of its text and then end_id; a null or empty text is end_id alone.
    Rows with null or repeated ids are documents like others. ids are little-endian unsigned
    32-bit values. Other columns of docs are not read; an empty docs gives an empty result.
    Sequences hold size ids, but for a few at the end of each group of merged tasks.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, pattern, added=True)
        packer = Packer(size, n_open)
        task = TaskContext.get().partitionId()
        number = task << 33
        rows: list[tuple] = []

        def add(window: list, unfilled: bool) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, total in window:
                raw = ids.tobytes()
                rows.append((doc, start, len(ids), zlib.crc32(raw), total, number, offset, task // MERGED_TASKS if unfilled else None, *([raw] if with_ids else [])))
                offset += len(ids)
            number += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)
            rows.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(end_id)
                for window in packer.place(doc.as_py(), ids):
                    add(window, False)
                if len(rows) >= 4096:
                    yield flush()
        full, last = packer.drain()
        for window in full:
            add(window, False)
        if last:
            add(last, True)
        yield flush()

    names = [c.split()[0] for c in _PIECE.split(", ")] + ["merge_group"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 8 + [pa.binary()] * with_ids
    schema = _PIECE + (", ids binary" if with_ids else "")
    pieces = staged(docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(pack, _PIECE + ", merge_group long" + (", ids binary" if with_ids else "")))
    done = pieces.filter("merge_group is null").drop("merge_group")
    merged = pieces.filter("merge_group is not null").groupBy("merge_group").applyInArrow(lambda group: merge_windows(group, size), schema)
    return done.unionByName(merged)


def merge_windows(group: pa.Table, size: int) -> pa.Table:
    """Whole windows, largest first, into the fullest sequence with room; a sequence takes the id of its first window."""
    windows, lengths = group.column("sequence_id").to_pylist(), group.column("length").to_pylist()
    sizes: dict[int, int] = {}
    for window, length in zip(windows, lengths, strict=True):
        sizes[window] = sizes.get(window, 0) + length
    fills: list[tuple[int, int]] = []
    moved: dict[int, tuple[int, int]] = {}
    for window, length in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        at = bisect_left(fills, (size - length + 1, -1)) - 1
        fill, sequence = fills.pop(at) if at >= 0 else (0, window)
        moved[window] = (sequence, fill)
        insort(fills, (fill + length, sequence))
    offsets = [offset + moved[w][1] for offset, w in zip(group.column("offset").to_pylist(), windows, strict=True)]
    changed = {"sequence_id": pa.array([moved[w][0] for w in windows], pa.int64()), "offset": pa.array(offsets, pa.int64())}
    return pa.table({c: changed.get(c, group.column(c)) for c in group.column_names if c != "merge_group"})
