"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The different pieces of the whole corpus are counted by a grouped aggregation. Merges are
replayed over pieces, not over texts: an inverted index leads from the rank of a pair of
tokens to the positions where the pair stands, over all pieces at hand; merges are replayed
in order of rank; each touches only the positions in its entry and their neighbours, whose
new pairs enter the index.

The most frequent pieces, bounded in number and in bytes, are replayed once for the whole
corpus, wherever and however often they stand, and their ids are broadcast; by Zipf's law
they are nearly all that stands in texts. The others hardly ever stand twice; a task
replays those of a slice of texts together, which moves no text.

Defined results: a null text is empty and has no ids; repeated rows get equal results; an
empty table gives an empty result; other columns than the named ones are ignored. Ids that
the vocabulary lacks can't be decoded: that raises an error.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, schema_of, slices, table
from .pieces import split_batch

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: What is broadcast at most: so many pieces of at most so many bytes each.
MOST_PIECES, MOST_PIECE_BYTES = 400_000, 48
#: Texts are split, and rare pieces replayed, in slices of so many bytes.
SLICE_BYTES = 4 << 20
_MERGES: dict = {}


class MergeReplay:
    """A vocabulary of ranked byte strings, and the replay of its merges."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.known, self.known_ids = pa.array(list(self.ranks), pa.binary()), np.array(list(self.ranks.values()), dtype=np.int32)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # Every pair of tokens that makes a token, sorted by pair.
        whole = [(self.ranks[t[:k]] << 32 | self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        pairs = np.array(sorted(whole), dtype=np.int64).reshape(-1, 2)
        self.pairs, self.merged = np.append(pairs[:, 0], np.int64(2**62)), np.append(pairs[:, 1], -1)
        # Tokens that a neighbour merges into a token of lower rank.
        self.hasty = np.zeros(len(self.tokens), dtype=bool)
        for token in (pairs[:, 0] >> 32, pairs[:, 0] & (2**32 - 1)):
            self.hasty[token[pairs[:, 1] < token]] = True

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of what pairs of tokens make together, or -1; of what is no token, -1 too."""
        key = np.maximum(a, 0).astype(np.int64) << 32 | np.maximum(b, 0)
        at = np.searchsorted(self.pairs, key)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.merged[at], -1)

    def encode(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, one piece after the other, and where each piece's ids end."""
        raw = pieces.cast(pa.binary())
        whole = pc.index_in(raw, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        open_ = (whole < 0) & (sizes > 0)
        flat, ends = self._replay(np.frombuffer(b"".join(raw.filter(pa.array(open_)).to_pylist()), dtype=np.uint8), sizes[open_])
        n = np.where(whole >= 0, 1, 0)
        n[open_] = np.diff(ends, prepend=0)
        out = np.empty(int(n.sum()), dtype=np.int32)
        of_open = np.repeat(open_, n)
        out[of_open], out[~of_open] = flat, self.known_ids[whole[whole >= 0]]
        return out, np.cumsum(n)

    def _replay(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends, n = np.cumsum(sizes), len(data)
        # A guard of no token stands before, between and after pieces.
        place = np.arange(n) + np.repeat(np.arange(1, len(sizes) + 1), sizes)
        token = np.full(n + len(sizes) + 1, -1, dtype=np.int32)
        token[place] = self.single[data]
        after, before = np.arange(1, len(token) + 1, dtype=np.int32), np.arange(-1, len(token) - 1, dtype=np.int32)
        piece = np.zeros(len(token), dtype=np.int32)
        piece[place] = np.repeat(np.arange(len(sizes)), sizes)

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Puts the pairs at these positions into the index."""
            rank = self.pair_ranks(token[at], token[after[at]])
            order = np.argsort(rank, kind="stable")
            sorted_rank = rank[order]
            starts = np.flatnonzero(np.diff(sorted_rank, prepend=-1))  # what makes no token comes first and is left out
            bounds = [*starts.tolist(), len(order)]
            for r, a, b in zip(sorted_rank[starts].tolist(), bounds, bounds[1:], strict=False):
                if r in index:
                    index[r].append(at[order[a:b]])
                else:
                    index[r] = [at[order[a:b]]]
                    heapq.heappush(heap, r)

        enter(place)
        while heap:
            r = heapq.heappop(heap)
            entry = index.pop(r)
            at = entry[0] if len(entry) == 1 else np.unique(np.concatenate(entry))
            at = at[token[at] >= 0]
            at = at[self.pair_ranks(token[at], token[after[at]]) == r]
            if not len(at):
                continue
            overlaps = after[at[:-1]] == at[1:]
            if overlaps.any():
                # In a run of pairs that overlap, every second one is merged: the leftmost goes first.
                number = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.append(False, overlaps), 0, number))
                at = at[(number - run) % 2 == 0]
            gone = after[at]
            far = after[gone]
            own = piece[at]
            if self.hasty[r] and (own[1:] == own[:-1]).any():
                # If a merge makes a pair of lower rank, that pair comes before what follows in the same piece, which waits.
                left = token[before[at]].copy()
                left[1:][far[:-1] == at[1:]] = r
                new = np.full(len(at), r, dtype=np.int32)
                on_left, on_right = self.pair_ranks(left, new), self.pair_ranks(new, token[far])
                early = ((on_left >= 0) & (on_left < r)) | ((on_right >= 0) & (on_right < r))
                passed = np.cumsum(early) - early  # early merges before this one, of any piece
                waits = passed > passed[np.searchsorted(own, own)]
                if waits.any():
                    index[r] = [at[waits]]
                    heapq.heappush(heap, r)
                    at, gone, far = at[~waits], gone[~waits], far[~waits]
            token[at], token[gone] = r, -2
            after[at], before[far] = far, at
            touched = np.empty(2 * len(at), dtype=at.dtype)
            touched[::2], touched[1::2] = before[at], at
            enter(touched[np.append(True, touched[1:] != touched[:-1])])
        rest = token[place]
        left_over = rest >= 0
        return rest[left_over], np.concatenate([[0], np.cumsum(left_over)])[ends]


def merges(path: str) -> MergeReplay:
    """One for each worker process, which Spark uses again for later tasks."""
    if path not in _MERGES:
        _MERGES[path] = MergeReplay(path)
    return _MERGES[path]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    places = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(values.astype(np.int32)))


def piece_counts(texts: DataFrame) -> DataFrame:
    """piece and n, how often it stands in the column text, which has no nulls; of every different piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(0), SLICE_BYTES):
                found = split_batch(batch.column(0).slice(at, n)).flatten().value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["piece", "n"])

    return texts.select("text").mapInArrow(run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent_pieces(texts: DataFrame, vocabulary: str, most_pieces: int) -> pa.Table:
    """piece and ids of the pieces that stand most often: whole classes of frequency, as many as hold most_pieces or fewer."""
    counted = piece_counts(texts).withColumn("class", F.floor(F.log2("n") * 8))
    short = cut(counted.where(F.octet_length("piece") <= MOST_PIECE_BYTES), "bpe-pieces")
    least, held = None, 0
    for r in sorted(short.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        held += r["count"]
        if held > most_pieces:
            break
        least = r["class"]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(*merges(vocabulary).encode(batch.column(0)))], names=["piece", "ids"])

    chosen = short.where(F.col("class") >= least) if least is not None else short.limit(0)
    return chosen.select("piece").mapInArrow(replay, "piece string, ids array<int>").toArrow()


def _gather(flat: np.ndarray, stops: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered at, of lists that end at stops[1:], one after the other; and where each ends."""
    first, n = stops[at], stops[at + 1] - stops[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(first - (ends - n), n)], ends


class _Coder:
    """Texts to ids: frequent pieces by their number, the others by a replay over those of the slice."""

    def __init__(self, frequent: pa.Table, vocabulary: str):
        self.vocabulary = vocabulary
        self.pieces = frequent.column("piece").combine_chunks()
        lists = frequent.column("ids").combine_chunks()
        self.flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        self.stops = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])

    def ids(self, texts: pa.StringArray) -> pa.ListArray:
        found = split_batch(texts)
        ends = np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        values = found.flatten()
        if not len(values):
            return _lists(np.zeros(0, dtype=np.int32), ends)
        coded = values.dictionary_encode()
        number = pc.index_in(coded.dictionary, value_set=self.pieces).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        rare = number < 0
        more, more_ends = merges(self.vocabulary).encode(coded.dictionary.filter(pa.array(rare)))
        number[rare] = len(self.pieces) + np.arange(rare.sum())
        flat, stops = np.concatenate([self.flat, more]), np.concatenate([self.stops, self.stops[-1] + more_ends])
        ids, stops = _gather(flat, stops, number[coded.indices.to_numpy(zero_copy_only=False)])
        return _lists(ids, np.concatenate([[0], stops])[ends])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, most_pieces: int = MOST_PIECES) -> DataFrame:
    """The id column and ids, an array of int, of every whole text. most_pieces: how many pieces are broadcast at most."""
    texts = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_Coder(frequent_pieces(texts, vocabulary, most_pieces), vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, n in slices(whole.column(1), SLICE_BYTES):
                batch = whole.slice(at, n)
                yield pa.RecordBatch.from_arrays([batch.column(0), shared.value.ids(batch.column(1))], names=["id", "ids"])

    return texts.mapInArrow(run, schema_of(texts, ["id"], "ids array<int>")).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY, ids_at_once: int = 1 << 20) -> DataFrame:
    """The id and ids columns and bytes, what the ids stand for; null ids: no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merges(vocabulary).tokens
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        data, stops = np.frombuffer(b"".join(tokens), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        for whole in batches:
            lengths = whole.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < whole.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), ids_at_once, side="right")))
                batch = whole.slice(at, n)
                ids = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(tokens) or not sizes[ids].all()):
                    raise ValueError("ids that the vocabulary lacks")
                out, ends = _gather(data, stops, ids)
                places = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths[at : at + n])])].astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(places), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=["id", "ids", "bytes"])
                at += n

    ready = encoded.select(column(id_col).alias("id"), column(ids_col).alias("ids"))
    return ready.mapInArrow(run, schema_of(ready, ["id", "ids"], "bytes binary")).toDF(id_col, ids_col, "bytes")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decode(encode(table(spark, sf_dir, "documents")))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
