"""Media columns: documents' bytes as FLAC streams, their PCM blocks and features.

A document's payload is its text in UTF-8 with zero bytes up to a positive multiple of
64; its samples are the bytes with the top bit flipped (8-bit PCM is signed). Streams
are written with a seek point for each block, read back with all check sums verified,
and given out as PCM blocks with their first sample, so that a block can be fetched
alone.

Defined cases: a null text counts as empty and gives 64 zero bytes; equal texts give
equal streams; repeated rows give repeated results; an empty table gives an empty
result. A stream whose check sums are wrong fails the task and is never skipped. A text
of any length is stored whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wavetally.llm import flac
from wavetally.llm.common import stash

PAD = 64
#: Bytes of payload that a worker holds as samples at a time (at least one document).
SLICE_BYTES = 8 << 20

MEDIA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, media binary"
BLOCKS = "doc_id bigint, block int, first_sample bigint, n_samples int, pcm binary"
DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % PAD if data else PAD)


def to_pcm(data: bytes) -> np.ndarray:
    return (np.frombuffer(data, dtype=np.uint8) ^ 0x80).view(np.int8)


def from_pcm(pcm: np.ndarray) -> bytes:
    return (pcm.view(np.uint8) ^ 0x80).tobytes()


def blocks_of(pcm: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(first sample, samples) of each PCM block."""
    return [(at, pcm[at : at + flac.BLOCK]) for at in range(0, len(pcm), flac.BLOCK)]


def feature(blocks: list[tuple[int, np.ndarray]]) -> str:
    """Whole-number features of the samples, block by block: sum, energy, peak, sign changes, blocks."""
    total = energy = peak = turns = 0
    before = None
    for _, block in blocks:
        wide, signs = block.astype(np.int64), block < 0
        total += int(wide.sum())
        energy += int((wide * wide).sum())
        peak = max(peak, int(np.abs(wide).max()))
        turns += int((signs[1:] != signs[:-1]).sum()) + (before is not None and bool(signs[0] != before))
        before = signs[-1]
    return f"sum={total};energy={energy};peak={peak};turns={turns};blocks={len(blocks)}"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    """(ids, texts) of a few documents at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= SLICE_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _texts(batches):
        whole = [payload(t) for t in texts]
        streams = flac.encode([to_pcm(p) for p in whole])
        sizes = [len((t or "").encode()) for t in texts]
        yield pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(list(map(len, whole)), pa.int64()), pa.array(streams, pa.binary())],
            names=["doc_id", "n_bytes", "payload_bytes", "media"],
        )


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[int], list[bytes], list[np.ndarray]]]:
    for batch in batches:
        media = batch.column("media")
        at = 0
        while at < batch.num_rows:
            size, streams = 0, []
            while at + len(streams) < batch.num_rows and size < SLICE_BYTES:
                streams.append(media[at + len(streams)].as_py())
                size += len(streams[-1])
            part = batch.slice(at, len(streams))
            at += len(streams)
            n = part.column("n_bytes").to_pylist() if "n_bytes" in part.schema.names else []
            yield part.column("doc_id").to_pylist(), n, streams, flac.decode(streams)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, _, pcm in _streams(batches):
        rows = [(i, b, at, len(part), part.tobytes()) for i, p in zip(ids, pcm, strict=True) for b, (at, part) in enumerate(blocks_of(p))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "block", "first_sample", "n_samples", "pcm"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, n, streams, pcm in _streams(batches):
        blocks = [blocks_of(p) for p in pcm]
        back = [b"".join(from_pcm(part) for _, part in own) for own in blocks]
        columns = {
            "doc_id": pa.array(ids, pa.int64()),
            "n_bytes": pa.array(n, pa.int64()),
            "payload_bytes": pa.array([len(b) for b in back], pa.int64()),
            "payload_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in back]),
            "tail_crc32": pa.array([zlib.crc32(b[-PAD:]) for b in back], pa.int64()),
            "media_bytes": pa.array([len(s) for s in streams], pa.int64()),
            "media_sha256": pa.array([hashlib.sha256(s).hexdigest() for s in streams]),
            "feature": pa.array([feature(own) for own in blocks]),
        }
        yield pa.record_batch(list(columns.values()), names=list(columns))


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media: each document as a FLAC stream."""
    return docs.select("doc_id", "text").mapInArrow(_encoded, MEDIA)


def read_blocks(media: DataFrame) -> DataFrame:
    """The PCM blocks of the streams in the column media: doc_id, block, first_sample, n_samples, pcm."""
    return media.select("doc_id", "media").mapInArrow(_blocks, BLOCKS)


def read_digests(media: DataFrame) -> DataFrame:
    """What stored streams (as of write_media) hold, without the streams themselves."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digests, DIGEST)


def digests(docs: DataFrame) -> DataFrame:
    """Each document written as a stream to the shared folder, read back from there block by block, and described."""
    return read_digests(stash(write_media(docs), "zstd"))
