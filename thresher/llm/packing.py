"""Packing by concatenating and cutting.

First pass: each task tokenizes its rows in order and notes, for every row, how many ids
the task wrote before it. Task totals become offsets by a prefix sum over one row a task.
Second pass: a row's place in the corpus is its task's offset plus what it noted, so fixed
windows cut it without any exchange; a document that crosses a window's end leaves a
boundary record on each side. All windows but the last are full.

Defined results: a null text is empty and packs as the closing id alone; repeated rows and
null ids are documents of their own; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import column, cut, schema_of, slices, table
from .pieces import PATTERN, PieceTable

CLOSING_ID = 1
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
_TABLES: dict[str, PieceTable] = {}


def _ranks(path: str, tokenizer: Tokenizer) -> dict[bytes, int] | None:
    """The vocabulary as ranked byte strings, if merging by rank whatever makes a token gives the tokenizer's ids.

    It does if merges stand in the order of their ids and every token, alone, is encoded as
    itself: two tokens that make a third are then what its own merges leave last, as no
    merge reached across its ends, and so they are a listed merge.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    vocabulary = {t: k for t, k in model["vocab"].items() if all(c in byte_of for c in t)}
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    alone = all([x.id for x in tokenizer.model.tokenize(t)] == [k] for t, k in vocabulary.items())
    if merged != sorted(merged) or model.get("dropout") or model.get("unk_token") or not alone:
        return None
    return {bytes(byte_of[c] for c in t): k for t, k in vocabulary.items()}


def _encoder(path: str) -> PieceTable:
    """One for each worker process, which Spark uses again for later tasks.

    Where both give the same ids, tiktoken takes fewer seconds for single pieces than tokenizers.
    """
    if path not in _TABLES:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        if ranks := _ranks(path, tokenizer):
            same = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _TABLES[path] = PieceTable(lambda new: [same.encode_ordinary(p) for p in new])
        else:
            _TABLES[path] = PieceTable(lambda new: [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)])
    return _TABLES[path]


def tokenize(docs: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """id, part, before, n_ids, ids (little-endian unsigned 32-bit, the closing id last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        encoder = _encoder(vocabulary)
        for whole in batches:
            for at, n in slices(whole.column(1)):
                batch = whole.slice(at, n)
                flat, ends = encoder.ids(batch.column(1))
                flat = np.insert(flat, ends, CLOSING_ID).astype("<u4")
                ends = ends + np.arange(1, len(ends) + 1)
                starts = np.concatenate([[0], ends[:-1]])
                places = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32))
                ids = pa.Array.from_buffers(pa.binary(), len(ends), [None, places, pa.py_buffer(flat)])
                columns = [batch.column(0), pa.array(np.full(len(ends), part)), pa.array(before + starts), pa.array(ends - starts), ids]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "before", "n_ids", "ids"])
                before += int(ends[-1])

    ready = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    return ready.mapInArrow(run, schema_of(ready, ["id"], "part bigint, before bigint, n_ids bigint, ids binary"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each piece: the id column, start, length, ids, doc_tokens, sequence_id, offset."""
    tokens = cut(tokenize(docs, id_col, text_col, vocabulary), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n_ids").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task of the first pass
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(offsets), "part").withColumn("at", F.col("base") + F.col("before"))
    window = F.expr(f"explode(sequence(at div {length}, (at + n_ids - 1) div {length}))")
    cuts = placed.select("id", "ids", "n_ids", "at", window.alias("sequence_id"))
    start = F.greatest(F.lit(0), F.col("sequence_id") * length - F.col("at"))
    stop = F.least(F.col("n_ids"), (F.col("sequence_id") + 1) * length - F.col("at"))
    found = cuts.withColumn("start", start).withColumn("length", stop - start)
    return found.select(
        F.col("id").alias(id_col), "start", "length",
        F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("ids"),
        F.col("n_ids").alias("doc_tokens"), "sequence_id",
        (F.col("at") + F.col("start") - F.col("sequence_id") * length).alias("offset"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
