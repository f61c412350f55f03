"""Audit of the stored tables: impossible values, unlikely cities, unknown codes, and what the transcripts are made of.

Each table is read once; every check is a conditional count, so the result is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.functions import codes
from wavetally.functions import text as T

# Bounds of each stored condition and forecast field.
CONDITION_BOUNDS = {"temperature_f": (-40, 120), "dewpoint_f": (-50, 90), "humidity_pct": (0, 100), "pressure_in": (25, 33), "wind_speed_mph": (0, 120)}
FORECAST_BOUNDS = {"high_f": (-30, 120), "low_f": (-40, 90), "precip_pct": (0, 100)}
NIGHT_LOW = 85
WORDLIKE, AREA_CODE = r"^[A-Z][a-zA-Z .'-]+$", r"^0\d{5}$"


def conditions(observations: DataFrame) -> DataFrame:
    """Values out of bounds by condition. observations: condition, value (number or text)."""
    value = F.col("value").try_cast("double")
    return observations.agg(*[F.count_if((F.col("condition") == c) & ~value.between(low, high)).alias(f"{c}_out") for c, (low, high) in CONDITION_BOUNDS.items()])


def forecasts(rows: DataFrame) -> DataFrame:
    """Forecast fields out of bounds, highs under lows, warm nights. rows: period, high_f, low_f, precip_pct."""
    return rows.agg(
        *[F.count_if(~F.col(c).between(low, high)).alias(f"{c}_out") for c, (low, high) in FORECAST_BOUNDS.items()],
        F.count_if(F.col("high_f") < F.col("low_f")).alias("high_under_low"),
        F.count_if(F.lower("period").contains("night") & (F.col("low_f") >= NIGHT_LOW)).alias("warm_nights"),
    )


def cities(latest: DataFrame, least: int = 2) -> DataFrame:
    """Cities that are shown, and those among them that are no likely name. latest: city, condition, sightings."""
    shown = (F.col("condition") == "temperature_f") & (F.col("sightings") >= least)
    odd = (F.length("city") <= 3) | ~F.col("city").rlike(WORDLIKE)
    return latest.agg(F.count_if(shown).alias("cities"), F.count_if(shown & odd).alias("odd_cities"))


def alerts(rows: DataFrame) -> DataFrame:
    """Alerts, those of unknown events, and area codes of the wrong form. rows: event, areas."""
    unknown = (F.col("event") != "") & ~F.upper("event").isin(*codes.EVENTS)
    wrong = F.size(F.filter(F.coalesce("areas", F.array()), lambda a: ~a.rlike(AREA_CODE)))
    return rows.agg(F.count(F.lit(1)).alias("alerts"), F.count_if(unknown).alias("unknown_events"), F.coalesce(F.sum(wrong), F.lit(0)).alias("bad_areas"))


def transcripts(reports: DataFrame) -> DataFrame:
    """Reports, texts that say nothing, and the share of unknown products in percent. reports: product_type, type, text."""
    low = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    core = F.trim(F.regexp_replace(low, r"[^a-z0-9 ]", ""))
    markers = [m.strip("[]()").replace("_", "") for m in T.SILENCE_MARKERS]
    nothing = (low != "") & core.isin("", *T.STOCK_PHRASES, *markers)
    unknown = F.coalesce("product_type", "type", F.lit("?")) == "unknown"
    n = F.count(F.lit(1))
    return reports.agg(n.alias("reports"), F.count_if(nothing).alias("nothing_said"), (100.0 * F.count_if(unknown) / F.greatest(F.lit(1), n)).alias("unknown_pct"))


def product_mix(reports: DataFrame) -> DataFrame:
    return reports.groupBy(F.coalesce("product_type", "type", F.lit("?")).alias("product")).agg(F.count(F.lit(1)).alias("n"))


def uncertain(rows: DataFrame, below: float = 0.6) -> DataFrame:
    """period, field, agreement of the newest issue's contested fields. rows: issued_at, period, confidence (map)."""
    newest = F.broadcast(rows.agg(F.max("issued_at").alias("issued_at")))  # one row
    return rows.join(newest, "issued_at").select("period", F.explode("confidence").alias("field", "agreement")).where(F.col("agreement") < below)


def audit(observations: DataFrame, forecast_rows: DataFrame, latest: DataFrame, alert_rows: DataFrame, reports: DataFrame) -> DataFrame:
    """All counts side by side: one row."""
    parts = [conditions(observations), forecasts(forecast_rows), cities(latest), alerts(alert_rows), transcripts(reports)]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # a row each
