"""The repeat vote over streams, with the same results as in batch for rows in order; the latest view and the webhook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavetally.config import DEFAULTS, Settings

VOTED = "city string, condition string, seq bigint, at double, value string, voted string, votes int, total int"
KEPT = "samples array<struct<value:string,at:double>>"


def best(samples: list[tuple[str, float]], seconds: float | None) -> tuple[str, int, int]:
    """The most frequent value of the pool, ties to the newest; its votes and the pool's size."""
    pool = [v for v, at in samples if seconds is None or samples[-1][1] - at <= seconds]
    counts: dict[str, int] = {}
    for v in pool:
        counts[v] = counts.get(v, 0) + 1
    top = max(counts.values())
    return next(v for v in reversed(pool) if counts[v] == top), top, len(pool)


def vote_stream(readings: DataFrame, settings: Settings = DEFAULTS, mode: str = "append") -> DataFrame:
    """readings: city, condition, seq, at (seconds), value. Rows of one micro-batch vote in order of seq;
    a row that comes in a later one votes on arrival. A series' state is its last readings."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        city, condition = key
        depth = settings.temperature_depth if condition == "temperature_f" else settings.vote_depth
        samples = [(s["value"], s["at"]) for s in (state.get[0] or [])] if state.exists else []
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, at, value in zip(rows["seq"], rows["at"], rows["value"], strict=True):
            samples = [*samples, (value, float(at))][-depth:]
            out.append((city, condition, seq, at, value, *best(samples, settings.vote_seconds)))
        state.update(([{"value": v, "at": a} for v, a in samples],))
        yield pd.DataFrame(out, columns=["city", "condition", "seq", "at", "value", "voted", "votes", "total"])

    return readings.groupBy("city", "condition").applyInPandasWithState(run, VOTED, KEPT, mode, GroupStateTimeout.NoTimeout)


def upsert_latest(path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of the latest view. Each batch writes a version in a folder of its own, so a batch that is
    run again after a failure replaces what it wrote and sightings are never counted twice. The last two versions stay."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/version={number - 1}") if number > 0 else None
        merge(before, batch).write.mode("overwrite").parquet(f"{path}/version={number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return write


def webhook(post: Callable[[dict], None]) -> Callable[[DataFrame, int], None]:
    """An opt-in foreachBatch sink that posts each alert and never raises."""

    def write(batch: DataFrame, number: int) -> None:
        for row in batch.toLocalIterator():
            try:
                post({"event": "alert", "data": row.asDict(recursive=True)})
            except OSError:
                continue

    return write
