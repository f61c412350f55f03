"""Health of the pipeline from its heartbeat and the age of the newest reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.functions.measures import age_minutes

# Minutes (and queued segments) after which each check fails.
LIMITS = {"heartbeat": 3, "audio": 5, "novel": 60, "stt": 10, "queue": 1, "readings": 180}


# The stamp or the counter that each kind of event moves.
TOUCHES = {"segment": "last_segment_at", "novel": "last_novel_at", "stt_ok": "last_stt_ok_at", "extraction": "last_extraction_at"}
COUNTS = {"segment": "segments", "novel": "novel", "repeat": "repeat", "shed": "shed", "stt_error": "stt_errors", "restart": "capture_restarts"}


def heartbeats(events: DataFrame) -> DataFrame:
    """Each station's heartbeat out of what happened (station, at, kind): first and last times, stamps and counters."""
    kind = lambda k: F.col("kind") == k
    return events.groupBy("station").agg(
        F.max("at").alias("updated_at"), F.min("at").alias("started_at"),
        *[F.max(F.when(kind(k), F.col("at"))).alias(c) for k, c in TOUCHES.items()],
        *[F.count_if(kind(k)).alias(c) for k, c in COUNTS.items()],
        F.greatest(F.lit(0), F.count_if(kind("novel")) - F.count_if(kind("stt_ok")) - F.count_if(kind("stt_error")) - F.count_if(kind("shed"))).alias("queue_depth"),
    )


def assess(heartbeats: DataFrame, now: Column, limits: dict[str, int] | None = None) -> DataFrame:
    """station, status, checks of each station's heartbeat.

    heartbeats: station, updated_at, started_at, last_segment_at, last_novel_at, last_stt_ok_at, queue_depth,
    reading_at. down (no fresh heartbeat) outranks degraded; checks come in a fixed order.
    """
    limit = LIMITS | (limits or {})
    age = lambda c: age_minutes(F.col(c), now)
    late = lambda a, key: a.isNull() | (a > limit[key])
    since_start = lambda c: F.coalesce(age(c), age("started_at"))
    faults = {
        "heartbeat": late(age("updated_at"), "heartbeat"),
        "audio": late(age("last_segment_at"), "audio"),
        "novel": late(since_start("last_novel_at"), "novel"),
        "stt": (F.coalesce("queue_depth", F.lit(0)) > limit["queue"]) & late(since_start("last_stt_ok_at"), "stt"),
        "readings": F.coalesce(age("reading_at") > limit["readings"], F.lit(False)),
    }
    checks = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in faults.items()]))
    status = F.when(faults["heartbeat"], "down").when(F.size(checks) > 0, "degraded").otherwise("ok")
    return heartbeats.select("station", status.alias("status"), checks.alias("checks"))
