"""Maintenance jobs: gain decisions, slot garbles, revotes and raw-report merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetally.functions import text as T

# Levels in dBFS at which the gain moves, and the mixer's rails and steps.
RMS_LOW, PEAK_CLIP, PEAK_HEADROOM = -30.0, -2.0, -14.0
BOOST_MAX, CAPTURE_MIDDLE, CAPTURE_MAX, CAPTURE_STEP = 3, 18, 31, 3
#: A word in the temperature slot, and the band that follows it.
SLOT_WORD = r"(?i)\b(\w+)\s+in the (?:lower|low|mid|middle|upper)\s+(?:\d{1,3}s|\w+ies)"


def gain_decision(rms_median: Column, peak_max: Column) -> Column:
    """lower near clipping, raise when quiet with headroom, else null."""
    return F.when(peak_max > PEAK_CLIP, "lower").when((rms_median < RMS_LOW) & (peak_max.isNull() | (peak_max < PEAK_HEADROOM)), "raise")


def next_gain(capture: Column, boost: Column, decision: Column) -> Column:
    """struct(capture, boost) after a decision: boost first, capture as the fine trim at the rails."""
    step = lambda c, b: F.struct(c.cast("int").alias("capture"), b.cast("int").alias("boost"))
    middle = F.lit(CAPTURE_MIDDLE)
    up = F.when(boost < BOOST_MAX, step(middle, boost + 1)).when(capture + CAPTURE_STEP <= CAPTURE_MAX, step(capture + CAPTURE_STEP, boost)).otherwise(step(capture, boost))
    down = F.when(boost > 0, step(middle, boost - 1)).when(capture - CAPTURE_STEP >= 0, step(capture - CAPTURE_STEP, boost)).otherwise(step(capture, boost))
    return F.when(decision == "raise", up).when(decision == "lower", down).otherwise(step(capture, boost))


def levels(samples: DataFrame) -> DataFrame:
    """station, median level and highest peak over distinct segments (station, segment_at, dbfs, peak)."""
    return samples.dropDuplicates(["station", "segment_at"]).groupBy("station").agg(F.percentile("dbfs", F.lit(0.5)).alias("rms_median"), F.max("peak").alias("peak_max"))


def garble_label(word: Column) -> Column:
    """Which label a garbled word in the temperature slot rhymes with; null if neither."""
    w = F.lower(word)
    return F.when(w.rlike("ow|ose|oes|oze"), "Lows").when(w.rlike("igh|ies|yes|ize|uys|y"), "Highs").when(w.contains("o"), "Lows").when(w.contains("i"), "Highs")


def garble_proposals(reports: DataFrame, least: int = 2) -> DataFrame:
    """word, target, in_slot, outside, verdict of words heard in the temperature slot that are no label yet."""
    words = reports.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("total"))
    slot = reports.select(F.explode(F.regexp_extract_all("text", F.lit(SLOT_WORD), 1)).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("in_slot"))
    known = [w.lower() for w in T.TERMS] + [v.lower() for vs in (*T.TERMS.values(), *T.SLOT_TERMS.values()) for v in vs]
    found = slot.where((F.col("in_slot") >= least) & ~F.col("word").isin(*known)).join(words, "word")
    found = found.withColumns({"target": garble_label(F.col("word")), "outside": F.col("total") - F.col("in_slot")})
    verdict = F.when(F.col("outside") > F.greatest(F.lit(1), F.floor(F.col("in_slot") / 2)), "context").otherwise("safe")
    return found.where(F.col("target").isNotNull()).select("word", "target", "in_slot", "outside", verdict.alias("verdict"))


def upsert_reports(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Whole documents by id; the last to arrive stays."""
    parts = [df.withColumn("__batch", F.lit(i)) for i, df in enumerate((stored, arrived))]
    both = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("id").orderBy(F.desc("__batch"), F.desc("captured_at"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__batch")


def revote(history: DataFrame, keys: list[str], hours: int = 18) -> DataFrame:
    """Each key's most frequent value in the hours before its last one, ties to the newest, with its agreement."""
    last = F.max("captured_at").over(Window.partitionBy(*keys))
    recent = history.withColumn("__l", last).where(F.col("captured_at") >= F.col("__l") - F.make_dt_interval(hours=F.lit(hours)))
    counted = recent.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"), F.max("captured_at").alias("newest"))
    best = counted.groupBy(*keys).agg(F.max_by(F.struct("value", "n"), F.struct("n", "newest")).alias("b"), F.sum("n").alias("total"))
    return best.select(*keys, "b.value", (F.col("b.n") / F.col("total")).alias("agreement"))


def fix_terms(reports: DataFrame, own_terms: dict[str, list[str]] | None = None) -> DataFrame:
    """Stored texts and their segments with terms folded."""
    fixed = reports.withColumn("text", T.fold_terms(F.col("text"), own_terms))
    if "segments" not in reports.columns:
        return fixed
    return fixed.withColumn("segments", F.transform("segments", lambda s: s.withField("text", T.fold_terms(s["text"], own_terms))))


def alert_priority(segments: DataFrame, bursts: DataFrame, seconds: int = 120) -> DataFrame:
    """segments (station, at) with priority 0 within so many seconds after a burst (station, at), else 10."""
    last = bursts.select("station", F.col("at").alias("burst"))
    both = segments.withColumn("burst", F.lit(None).cast("timestamp_ntz")).unionByName(last.withColumn("at", F.col("burst")), allowMissingColumns=True)
    w = Window.partitionBy("station").orderBy("at", F.col("burst").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("recent", F.last("burst", ignorenulls=True).over(w)).where(F.col("burst").isNull())
    near = F.coalesce(F.col("at") <= F.col("recent") + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)")), F.lit(False))
    return seen.withColumn("priority", F.when(near, 0).otherwise(10)).drop("burst", "recent")

