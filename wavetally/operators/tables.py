"""Table writers as aggregates: which row of a key stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetally.config import DEFAULTS


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """Insert-or-ignore: the first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert: the last row of each key, as one partial aggregation."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return last.select(*[F.col(c) if c in key else F.col(f"__r.{c}") for c in df.columns])


def latest_with_sightings(voted: DataFrame, key: list[str], order: list[str], at: str = "captured_at") -> DataFrame:
    """The latest view: each key's last vote, how often it was seen, first and last time."""
    newest = F.max_by(F.struct(F.col("voted").alias("value"), "votes", "total", F.col(at).alias("last_seen")), F.struct(*order))
    out = voted.groupBy(*key).agg(newest.alias("__r"), F.count(F.lit(1)).alias("sightings"), F.min(at).alias("first_seen"))
    return out.select(*key, "__r.value", "__r.votes", "__r.total", "sightings", "first_seen", "__r.last_seen")


def alert_expiry(captured_at: Column, purge_minutes: Column) -> Column:
    return captured_at + F.make_dt_interval(mins=F.coalesce(purge_minutes.cast("int"), F.lit(0)))


def alerts_table(alerts: DataFrame, order: list[str]) -> DataFrame:
    """Alerts by id: the first row, but the last expiry."""
    stamped = alerts.withColumn("expires_at", alert_expiry(F.col("captured_at"), F.col("purge_minutes")))
    rest = [c for c in stamped.columns if c not in ("id", "expires_at")]
    out = stamped.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"), F.max_by("expires_at", F.struct(*order)).alias("expires_at"))
    return out.select("id", *[F.col(f"__r.{c}") for c in rest], "expires_at")


def forecast_table(issued: DataFrame, home: str | None = None) -> DataFrame:
    """Issuances by station, issued_at, city and period: the last of each stays. issued: station, seq (captured_at, id), period, city, fields.

    Issues before an area was named are the home city's.
    """
    rows = issued.withColumns({"issued_at": F.col("seq.captured_at"), "city": F.coalesce("city", F.lit(home))})
    return last_wins(rows, ["station", "issued_at", "city", "period"], ["seq"])


def confident(reports: DataFrame, floor: float = DEFAULTS.confidence_floor) -> DataFrame:
    """Reports that may vote: confidence unmeasured (null or 0) or at the floor."""
    c = F.coalesce(F.col("avg_confidence"), F.lit(0.0))
    return reports.where(~((c > 0) & (c < floor)))


def prune(latest: DataFrame, home: str, now: Column, hours: int = DEFAULTS.prune_hours) -> DataFrame:
    """The latest view without other cities' rows that are too old."""
    return latest.where((F.col("city") == home) | (F.col("last_seen") >= now - F.make_dt_interval(hours=F.lit(hours))))


def merge_spellings(latest: DataFrame, aliases: DataFrame) -> DataFrame:
    """Cities folded to their canonical spelling and their rows merged; on equal times the good spelling's value stays.

    aliases: heard, canonical - a small table of a station's profile.
    """
    named = latest.join(aliases, F.lower("city") == F.lower("heard"), "left")
    named = named.withColumns({"good": F.col("canonical").isNull().cast("int"), "name": F.coalesce("canonical", "city")})
    newest = F.max_by(F.struct("value", "votes", "total"), F.struct("last_seen", "good"))
    out = named.groupBy(F.col("name").alias("city"), "condition").agg(
        newest.alias("__r"), F.sum("sightings").alias("sightings"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    return out.select("city", "condition", "__r.value", "__r.votes", "__r.total", "sightings", "first_seen", "last_seen")
