"""Sources: stored reports, transcriber JSON, fingerprint dumps, WAV files; and the sinks that replace tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetally.operators import dsp

RAW_REPORTS = (
    "schema_version INT, id STRING, station STRING, frequency_mhz DOUBLE, captured_at TIMESTAMP, duration_s DOUBLE, type STRING, product_type STRING, text STRING, "
    "segments ARRAY<STRUCT<start_s DOUBLE, end_s DOUBLE, text STRING, confidence DOUBLE>>, stt STRUCT<engine STRING, model STRING, avg_confidence DOUBLE>, "
    "fingerprint STRING, supersedes STRING, alert STRUCT<originator STRING, event STRING, areas ARRAY<STRING>, counties ARRAY<STRING>, purge_minutes INT, issued_raw STRING, station STRING, raw STRING>"
)
TRANSCRIBER = (
    "result STRUCT<language STRING>, transcription ARRAY<STRUCT<text STRING, offsets STRUCT<`from` BIGINT, `to` BIGINT>, tokens ARRAY<STRUCT<text STRING, p DOUBLE>>>>"
)


def raw_reports(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Stored reports from JSON lines, as a batch or a stream of new files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(RAW_REPORTS).json(path)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcriber output, one JSON document a file."""
    return spark.read.schema(TRANSCRIBER).json(path, multiLine=True).withColumn("file", F.input_file_name())


def token_confidence(tokens):
    """Mean probability of the spoken tokens; special ones, in square brackets with an underscore, don't count."""
    spoken = F.filter(tokens, lambda t: ~t["text"].startswith("[_"))
    return F.when(F.size(spoken) > 0, F.aggregate(spoken, F.lit(0.0), lambda a, t: a + t["p"]) / F.size(spoken)).otherwise(F.lit(0.0))


def transcript_segments(documents: DataFrame) -> DataFrame:
    """file, position, start_s, end_s, text, confidence, tokens of each segment."""
    each = documents.select("file", F.posexplode("transcription").alias("position", "s"))
    spoken = F.filter("s.tokens", lambda t: ~t["text"].startswith("[_"))
    return each.select("file", "position", (F.col("s.offsets.from") / 1000).alias("start_s"), (F.col("s.offsets.to") / 1000).alias("end_s"), F.trim("s.text").alias("text"), token_confidence(F.col("s.tokens")).alias("confidence"), F.size(spoken).alias("tokens"))


def weighted_confidence(segments: DataFrame, key: str = "file") -> DataFrame:
    """Each transcript's mean confidence, weighted by tokens."""
    total = F.sum("tokens")
    return segments.groupBy(key).agg(F.when(total > 0, F.sum(F.col("confidence") * F.col("tokens")) / total).otherwise(F.lit(0.0)).alias("avg_confidence"))


def pcm_frames(spark: SparkSession, path: str, frame_bytes: int = 640, rate: int = dsp.RATE, stream: bool = False) -> DataFrame:
    """path, frame, at_s, pcm: whole frames of raw 16-bit sound files, as a batch or a stream of new files.

    A rest shorter than a frame is left out; times run from the file's start.
    """
    reader = (spark.readStream.schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY") if stream else spark.read).format("binaryFile")
    files = reader.load(path).select("path", "content", F.floor(F.length("content") / frame_bytes).cast("int").alias("n")).where("n > 0")
    frames = files.select("path", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame"))
    cut = F.substring(F.col("content"), F.col("frame") * frame_bytes + 1, F.lit(frame_bytes))
    return frames.select("path", F.col("frame").cast("bigint").alias("frame"), (F.col("frame") * (frame_bytes / 2 / rate)).alias("at_s"), cut.alias("pcm"))


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, pcm (16-bit samples) of WAV files."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [dsp.read_wav(c) for c in batch.column("content").to_pylist()]
            yield pa.record_batch([batch.column("path"), pa.array([r for _, r in got], pa.int32()), pa.array([x.tobytes() for x, _ in got], pa.binary())], names=["path", "rate", "pcm"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, rate int, pcm binary")


def fingerprint_dumps(spark: SparkSession, path: str, size: int = dsp.MELS * dsp.TIME_BINS) -> DataFrame:
    """stamp, vector of fixed-width dump files."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = dsp.read_dump(content, size)
                yield pa.record_batch([pa.array([s for s, _ in rows], pa.string()), pa.array([v.tolist() for _, v in rows], pa.list_(pa.float32()))], names=["stamp", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "stamp string, vector array<float>")


def write_heartbeat(payload: dict, path: str) -> None:
    """The newest heartbeat as one JSON file, replaced in one step; a failure never reaches the caller."""
    try:
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            json.dump(payload, f)
        os.replace(f"{path}.tmp", path)
    except OSError:
        pass


def heartbeat_sink(path: str, to_table: str):
    """A foreachBatch writer of heartbeats (of health.heartbeats): a JSON file for each station and, a folder for each
    batch, the rows themselves; a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to_table}/batch={number}")
        for row in batch.sparkSession.read.parquet(f"{to_table}/batch={number}").toLocalIterator():  # a row a station
            write_heartbeat({k: v if isinstance(v, int) or v is None else str(v) for k, v in row.asDict().items()}, f"{path}/{row['station']}.json")

    return write


def replace_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Writes a projected table anew; raw reports are never replaced."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
