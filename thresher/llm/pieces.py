"""Texts as pieces, and pieces as token ids.

A batch of texts is split at once: the split pattern of the byte-level vocabularies is
decided by the classes of neighbouring characters, so array operations find every piece's
start. Each different piece of a batch is encoded once; the ids of all texts are gathered
by index.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)
LETTER, NUMBER, SPACE, OTHER, BREAK = range(5)


@cache
def _classes() -> np.ndarray:
    """The class of every code point; a guard after the last."""
    whole = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    found = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, whole):
            found[m.start() : m.end()] = kind
    return found


def split(text: str) -> list[str]:
    return _SPLIT.findall(text)


def split_batch(texts: pa.StringArray) -> pa.ListArray:
    """The pieces of each text (no nulls): the matches of PATTERN, in order."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = b"".join(texts.cast(pa.binary()).to_pylist())
    code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(code)
    ends = np.cumsum(sizes)
    if not n:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, dtype=np.int32)), pa.array([], pa.string()))
    kind = _classes()[code]
    first = np.zeros(n + 1, dtype=bool)  # of a text
    first[np.concatenate([[0], ends])] = True
    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = BREAK, kind[:-1]
    before[first[:-1]] = BREAK
    after = np.empty(n, dtype=np.uint8)
    after[-1], after[:-1] = BREAK, kind[1:]
    after[first[1:]] = BREAK

    run = kind != before
    space = kind == SPACE
    # Of white space before something else the last character stands alone, or leads the next run if it is a blank.
    last = space & (after != SPACE) & (after != BREAK)
    leads = last & (code == 32)
    start = run | last
    start[1:] &= ~(leads[:-1] & ~space[1:])

    # An apostrophe that starts a piece takes a contraction's letters with it.
    quotes = np.flatnonzero((code == 39) & start & (after == LETTER))
    if len(quotes):
        padded = np.concatenate([code, np.zeros(3, dtype=np.uint32)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        pair &= ~first[np.minimum(quotes + 2, n)]
        taken = np.where(np.isin(one, [115, 116, 109, 100]), 1, np.where(pair, 2, 0))
        quotes, taken = quotes[taken > 0], taken[taken > 0]
        start[quotes + 1] = False
        rest = quotes + 1 + taken
        inside = rest < n
        rest = rest[inside]
        start[rest[~first[rest]]] = True
    at = np.flatnonzero(start)
    counts = np.searchsorted(at, np.concatenate([[0], ends]))
    width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000).astype(np.int64)
    places = np.concatenate([[0], np.cumsum(width)])[np.concatenate([at, [n]])].astype(np.int32)
    values = pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(raw))
    return pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), values)


class PieceTable:
    """Ids of pieces met so far. When it holds too many it keeps those that the batch at hand uses."""

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], most: int = 300_000):
        self.encode, self.most = encode, most
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.ends = np.zeros(1, dtype=np.int64)

    def _shrink(self, used: list[str]) -> None:
        kept = [p for p in used if p in self.number]
        at = np.fromiter((self.number[p] for p in kept), dtype=np.int64, count=len(kept))
        self.flat, ends = self._gather(at)
        self.ends = np.concatenate([[0], ends])
        self.number = {p: k for k, p in enumerate(kept)}

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbered pieces, and where each piece's ids end."""
        first, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(first - (ends - n), n)], ends

    def _numbers(self, wanted: list[str]) -> np.ndarray:
        if len(self.number) + len(wanted) > self.most:
            self._shrink(wanted)
        number = self.number
        new = [p for p in wanted if p not in number]
        if new:
            ids = self.encode(new)
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = np.fromiter((x for one in ids for x in one), dtype=np.uint32, count=int(sizes.sum()))
            self.flat = np.concatenate([self.flat, flat])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return np.fromiter(map(number.__getitem__, wanted), dtype=np.int64, count=len(wanted))

    def learn(self, texts: pa.StringArray, rows_at_once: int = 1000) -> None:
        """Encodes what is new in many texts at once: batches of new pieces cost less than the same pieces apart."""
        found: dict[str, None] = {}
        for k in range(0, len(texts), rows_at_once):
            found.update(dict.fromkeys(split_batch(texts.slice(k, rows_at_once)).flatten().unique().to_pylist()))
        self._numbers(list(found))

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """For texts without nulls: all ids in order, and where each text's ids end."""
        lists = split_batch(texts)
        values = lists.flatten()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(values):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(sizes), dtype=np.int64)
        known = values.dictionary_encode()
        at = self._numbers(known.dictionary.to_pylist())[known.indices.to_numpy(zero_copy_only=False)]
        out, ends = self._gather(at)
        return out, np.concatenate([[0], ends])[np.cumsum(sizes)]
