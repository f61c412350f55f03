"""The novelty gate, text dedup and speech segments over streams: the batch folds with their history kept as state.

Rows of one micro-batch are taken in order of their sequence; a row that comes in a later one is taken on arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavetally.config import DEFAULTS, Settings
from wavetally.operators import folds

GATE = "station string, seq bigint, admitted boolean, similarity double"
GATE_STATE = "kept array<struct<at:double,vector:array<float>>>"
DEDUP = "station string, id string, verdict string, of string, ratio double"
DEDUP_STATE = "kept array<struct<id:string,text:string,product:string>>"
SPEECH = "station string, first_frame bigint, last_frame bigint"
SPEECH_STATE = "before array<bigint>, open array<bigint>, quiet int"


def _folded(df: DataFrame, order: str, schema: str, kept: str, run: Callable[[str, pd.DataFrame, tuple | None], tuple[list[tuple], tuple]]) -> DataFrame:
    """run: a station's rows in order and its state (None at first) to result rows and the new state."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order)
        out, now = run(key[0], rows, state.get if state.exists else None)
        state.update(now)
        yield pd.DataFrame(out, columns=columns)

    return df.groupBy("station").applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.NoTimeout)


def gate_stream(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """As folds.gate. df: station, seq, at (seconds), vector."""

    def run(station: str, rows: pd.DataFrame, state: tuple | None) -> tuple[list[tuple], tuple]:
        gate = folds.NoveltyGate(settings)
        gate.kept.extend((k["at"], np.asarray(k["vector"], dtype=np.float32)) for k in (state[0] if state else []))
        out = [(station, seq, *gate.step(at, v)) for seq, at, v in zip(rows["seq"], rows["at"], rows["vector"], strict=True)]
        return out, ([{"at": float(a), "vector": v.tolist()} for a, v in gate.kept],)

    return _folded(df.select("station", "seq", "at", "vector"), "seq", GATE, GATE_STATE, run)


def dedup_stream(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """As folds.dedup_texts. df: station, seq, id, text (normalised), product_type."""

    def run(station: str, rows: pd.DataFrame, state: tuple | None) -> tuple[list[tuple], tuple]:
        dedup = folds.TextDedup(settings)
        dedup.kept.extend((k["id"], k["text"], k["product"]) for k in (state[0] if state else []))
        out = [(station, i, *dedup.step(i, t or "", p)) for i, t, p in zip(rows["id"], rows["text"], rows["product_type"], strict=True)]
        return out, ([{"id": i, "text": t, "product": p} for i, t, p in dedup.kept],)

    return _folded(df.select("station", "seq", "id", "text", "product_type"), "seq", DEDUP, DEDUP_STATE, run)


def segment_stream(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """As folds.segments, but a segment that is open when the stream ends stays open. df: station, frame, dbfs."""

    def run(station: str, rows: pd.DataFrame, state: tuple | None) -> tuple[list[tuple], tuple]:
        segmenter = folds.Segmenter(settings)
        if state:
            segmenter.before.extend(state[0])
            segmenter.open, segmenter.quiet = list(state[1]), state[2]
        out = [(station, *x) for f, d in zip(rows["frame"], rows["dbfs"], strict=True) if (x := segmenter.step(int(f), float(d)))]
        return out, (list(segmenter.before), list(segmenter.open), segmenter.quiet)

    return _folded(df.select("station", "frame", "dbfs"), "frame", SPEECH, SPEECH_STATE, run)
