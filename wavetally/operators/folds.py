"""Operators whose history depends on their own decisions: novelty gate, text dedup, speech segments.

Each is a Python class with one step, run in order over a station's rows: in batch by grouping, in a stream by
keeping its state. Histories are bounded, so is the state. Stations run side by side.
"""

from __future__ import annotations

import hashlib
from collections import deque
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetally.config import DEFAULTS, Settings


class NoveltyGate:
    """Admits a vector whose best cosine against admitted, not too old ones is under the limit."""

    def __init__(self, settings: Settings = DEFAULTS):
        self.limit, self.seconds = settings.gate_similarity, settings.gate_minutes * 60
        self.kept: deque = deque(maxlen=settings.gate_history)

    def step(self, at: float, vector) -> tuple[bool, float]:
        while self.seconds and self.kept and at - self.kept[0][0] > self.seconds:
            self.kept.popleft()
        v = np.asarray(vector, dtype=np.float32)
        best = max((float(np.dot(k, v)) for _, k in self.kept), default=0.0)
        if best < self.limit:
            self.kept.append((at, v))
        return best < self.limit, best


class TextDedup:
    """Compares a text with the last kept ones: new, a duplicate (not kept), or an update of the same product."""

    def __init__(self, settings: Settings = DEFAULTS):
        self.same, self.near = settings.duplicate_ratio, settings.update_ratio
        self.kept: deque = deque(maxlen=settings.dedup_history)

    def step(self, doc_id: str, text: str, product: str | None) -> tuple[str, str | None, float]:
        best, of = 0.0, None
        for entry in self.kept:
            # No ratio can exceed this bound of the lengths.
            if text or entry[1]:
                if 2 * min(len(text), len(entry[1])) / (len(text) + len(entry[1])) <= best:
                    continue
            matcher = SequenceMatcher(None, text, entry[1])
            # The cheaper bounds, each of them at least the ratio.
            ratio = 0.0 if matcher.real_quick_ratio() <= best or matcher.quick_ratio() <= best else matcher.ratio()
            if ratio > best:
                best, of = ratio, entry
        if of and best >= self.same:
            return "duplicate", of[0], best
        self.kept.append((doc_id, text, product))
        if of and best >= self.near and of[2] == product:
            return "update", of[0], best
        return "new", None, best


class Segmenter:
    """Speech segments out of frame levels: a pre-roll before, closed by silence or length, short ones dropped."""

    def __init__(self, settings: Settings = DEFAULTS):
        s = settings
        frames = lambda seconds: int(round(seconds / s.frame_s))
        self.level, self.pad, self.hush, self.most, self.least = s.speech_dbfs, frames(s.pre_roll_s), frames(s.silence_s), frames(s.max_segment_s), frames(s.min_speech_s)
        self.before: deque = deque(maxlen=self.pad)
        self.open: list[int] = []
        self.quiet = 0

    def _close(self) -> tuple[int, int] | None:
        done, self.open, self.quiet = self.open, [], 0
        self.before.clear()
        return (done[0], done[-1]) if len(done) >= self.least else None

    def step(self, frame: int, dbfs: float) -> tuple[int, int] | None:
        speech = dbfs > self.level
        if not self.open:
            if not speech:
                self.before.append(frame)
                return None
            self.open = [*self.before, frame]
            return None
        self.open.append(frame)
        self.quiet = 0 if speech else self.quiet + 1
        return self._close() if self.quiet >= self.hush or len(self.open) >= self.most else None

    def flush(self) -> tuple[int, int] | None:
        return self._close() if self.open else None


def gate(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """station, seq, admitted, similarity for rows station, seq, at (seconds), vector."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        g = NoveltyGate(settings)
        rows = rows.sort_values("seq")
        got = [g.step(at, v) for at, v in zip(rows["at"], rows["vector"], strict=True)]
        return pd.DataFrame({"station": rows["station"], "seq": rows["seq"], "admitted": [a for a, _ in got], "similarity": [s for _, s in got]})

    return df.select("station", "seq", "at", "vector").groupBy("station").applyInPandas(run, "station string, seq bigint, admitted boolean, similarity double")


def dedup_texts(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """station, id, verdict, of, ratio for rows station, seq, id, text, product_type (text already normalised)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        d = TextDedup(settings)
        rows = rows.sort_values("seq")
        got = [d.step(i, t or "", p) for i, t, p in zip(rows["id"], rows["text"], rows["product_type"], strict=True)]
        return pd.DataFrame({"station": rows["station"], "id": rows["id"], "verdict": [v for v, _, _ in got], "of": [o for _, o, _ in got], "ratio": [r for _, _, r in got]})

    return df.select("station", "seq", "id", "text", "product_type").groupBy("station").applyInPandas(run, "station string, id string, verdict string, of string, ratio double")


def segments(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """station, first_frame, last_frame of speech for rows station, frame, dbfs."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s = Segmenter(settings)
        rows = rows.sort_values("frame")
        out = [x for f, d in zip(rows["frame"], rows["dbfs"], strict=True) if (x := s.step(f, d))]
        if last := s.flush():
            out.append(last)
        station = rows["station"].iloc[0]
        ends = [pd.Series([x[i] for x in out], dtype="int64") for i in range(2)]
        return pd.DataFrame({"station": pd.Series([station] * len(out), dtype="object"), "first_frame": ends[0], "last_frame": ends[1]})

    return df.select("station", "frame", "dbfs").groupBy("station").applyInPandas(run, "station string, first_frame bigint, last_frame bigint")


def recent_similarity(df: DataFrame, back: int = 20, limit: float = 0.5, bucket: int = 4096) -> DataFrame:
    """id, best, is_repeat: the largest inner product of a vector with those of the last ids. df: id (whole numbers), v.

    Rows are dealt out by ranges of ids, each with the last ones of the range before.
    """
    own = F.floor(F.col("id") / bucket)
    near = F.when(F.col("id") % bucket >= bucket - back, F.array(own, own + 1)).otherwise(F.array(own))
    rows = df.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"), own.alias("__own"), F.explode(near).alias("__at"))
    frame = Window.partitionBy("__at").orderBy("id").rangeBetween(-back, -1)
    past = rows.withColumn("__past", F.collect_list("v").over(frame)).where((F.size("__past") > 0) & (F.col("__own") == F.col("__at")))
    dots = F.transform("__past", lambda p: F.aggregate(F.zip_with("v", p, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x))
    return past.select("id", F.array_max(dots).alias("best")).withColumn("is_repeat", F.col("best") >= limit)


def islands(df: DataFrame, gap_s: float) -> DataFrame:
    """station, start_at, end_at, frames: stretches of rows (station, at) without a longer gap."""
    w = Window.partitionBy("station").orderBy("at")
    apart = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(w).cast("timestamp")) > gap_s * 1_000_000
    marked = df.select("station", "at").withColumn("__gap", F.coalesce(apart, F.lit(True)).cast("int"))
    numbered = marked.withColumn("__n", F.sum("__gap").over(w))
    return numbered.groupBy("station", "__n").agg(F.min("at").alias("start_at"), F.max("at").alias("end_at"), F.count(F.lit(1)).alias("frames")).drop("__n")


def digest(bits: np.ndarray) -> str:
    return hashlib.sha1(np.packbits(bits).tobytes()).hexdigest()[:16]
