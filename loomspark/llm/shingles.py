"""Hashed word shingles of texts, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SIZE = 5
_BYTE = np.frombuffer(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)), np.uint8)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_RANDOM = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) for i in range(SIZE)], np.uint64)
#: Bytes of text hashed at once.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    buffer = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    inside = ~_SPACE[buffer]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the buffer starts and ends outside words
    starts, ends = edge[::2], edge[1::2]
    # each byte is mixed with its place in its word before bytes are added: sums of such terms follow no rule of arithmetic
    begun = np.zeros(len(buffer), np.int64)
    begun[starts] = np.diff(starts, prepend=0)
    place = (np.arange(len(buffer)) - np.cumsum(begun)).astype(np.uint64)
    total = np.cumsum(mix(_RANDOM[_BYTE[buffer]] + place * _STEP))
    words = mix(total[ends - 1] - total[starts - 1])
    bounds = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
    n = len(words) - SIZE + 1
    whole = np.zeros(max(n, 0), np.uint64)
    for i in range(SIZE if n > 0 else 0):
        whole += words[i : i + n] * _PLACE[i]
    whole = mix(whole)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= SIZE:
            out.append(np.unique(whole[a : b - SIZE + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (UTF-8), in order.

    Words are runs without white space, A-Z lower-cased. A text of fewer than SIZE words has one
    shingle, of all its words; one without words has none.
    """
    chunk: list[bytes] = []
    size = 0
    for text in texts:
        if chunk and size + len(text) > CHUNK:
            yield from _hashed(chunk)
            chunk, size = [], 0
        chunk.append(text)
        size += len(text) + 1
    if chunk:
        yield from _hashed(chunk)
