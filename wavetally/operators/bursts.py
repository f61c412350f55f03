"""The alert monitor: bursts of the alert tones in a stream of frames, decoded when they end, each header told once.

History depends on what was told, so both are folds over a station's frames or headers; their state is a ring of
seconds of sound and the last headers. Stations run side by side.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wavetally.operators import dsp

# Seconds of sound that are kept and that are tested, quiet that ends a burst, headers remembered.
BUFFER_S, DETECT_S, QUIET_S, FRAME_S = 13.0, 0.4, 1.5, 0.02
REMEMBERED = 32


class Told:
    """Whether a header is not among the last ones told."""

    def __init__(self, remembered: int = REMEMBERED):
        self.recent: deque[str] = deque(maxlen=remembered)

    def step(self, raw: str) -> bool:
        if raw in self.recent:
            return False
        self.recent.append(raw)
        return True


class Monitor:
    """Frames of 16-bit samples in, headers out when a burst has ended."""

    def __init__(self, rate: int = dsp.RATE, frame_s: float = FRAME_S):
        frames = lambda seconds: max(1, int(seconds / frame_s))
        self.rate, self.frame_s, self.tested = rate, frame_s, frames(DETECT_S)
        self.ring: deque[np.ndarray] = deque(maxlen=frames(BUFFER_S))
        self.inside, self.quiet, self.told = False, 0.0, Told()

    def step(self, frame: np.ndarray) -> list[str]:
        self.ring.append(frame)
        if len(self.ring) < self.tested:
            return []
        if dsp.is_tone_burst(np.concatenate([self.ring[i] for i in range(-self.tested, 0)]), self.rate):
            self.inside, self.quiet = True, 0.0
        elif self.inside:
            self.quiet += self.frame_s
            if self.quiet >= QUIET_S:
                self.inside = False
                return [h for h in dsp.decode_headers(np.concatenate(self.ring), self.rate) if self.told.step(h)]
        return []


def monitored(frames: DataFrame, rate: int = dsp.RATE, frame_s: float = FRAME_S) -> DataFrame:
    """station, frame, raw: headers and the frame with which each was told, for rows station, frame, pcm."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        monitor, rows = Monitor(rate, frame_s), rows.sort_values("frame")
        out = [(rows["station"].iloc[0], f, h) for f, p in zip(rows["frame"], rows["pcm"], strict=True) for h in monitor.step(np.frombuffer(p, "<i2"))]
        return pd.DataFrame(out, columns=["station", "frame", "raw"])

    return frames.select("station", "frame", "pcm").groupBy("station").applyInPandas(run, "station string, frame bigint, raw string")


def told_once(headers: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """headers (station, seq, raw) without those that are among their station's last ones told."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        told, rows = Told(remembered), rows.sort_values("seq")
        return rows[[told.step(r) for r in rows["raw"]]]

    return headers.select("station", "seq", "raw").groupBy("station").applyInPandas(run, "station string, seq bigint, raw string")
