"""Store readers and the query surface: the snapshot, lists, histories and paging over projected tables.

Each takes the projected tables of ``operators.project.replay`` (or tables of the same columns) and a fixed now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetally.config import DEFAULTS
from wavetally.functions import codes, measures
from wavetally.operators import linking


def reports(raw: DataFrame, start=None, end=None, product: str | None = None, search: str | None = None) -> DataFrame:
    """Raw reports under filters: an inclusive range of time, a product, a piece of text in any case."""
    out = raw
    if start is not None:
        out = out.where(F.col("captured_at") >= start)
    if end is not None:
        out = out.where(F.col("captured_at") <= end)
    if product is not None:
        out = out.where(F.col("product_type") == product)
    if search is not None:
        plain = search.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
        out = out.where(F.ilike("text", F.lit(f"%{plain}%")))
    return out


def since(df: DataFrame, at: str, stamp, limit: int) -> DataFrame:
    """Rows strictly after a stamp, oldest first; ties in order of the other columns given."""
    return df.where(F.col(at) > stamp).orderBy(at, *[c for c in ("id", "city", "condition") if c in df.columns]).limit(limit)


def recent(raw: DataFrame, n: int) -> DataFrame:
    """The newest n reports, oldest first."""
    return raw.orderBy(F.desc("captured_at"), F.desc("id")).limit(n).orderBy("captured_at", "id")


def last_airing(raw: DataFrame, product: str) -> DataFrame:
    return raw.where(F.col("product_type") == product).agg(F.max("captured_at").alias("captured_at"))


def heartbeat(rows: DataFrame) -> DataFrame:
    """The newest heartbeat of each station."""
    rest = [c for c in rows.columns if c != "station"]
    return rows.groupBy("station").agg(F.max_by(F.struct(*rest), "updated_at").alias("h")).select("station", "h.*")


def marked(latest: DataFrame, now: Column, stale_minutes: float = DEFAULTS.stale_minutes, fresh: bool = False, least: int = DEFAULTS.min_sightings) -> DataFrame:
    """Latest rows seen often enough, with age, staleness, agreement, trust and its label."""
    rows = latest.where(F.col("sightings") >= least).withColumn("stale", measures.is_stale(F.col("last_seen"), now, stale_minutes))
    rows = rows.where(~F.col("stale")) if fresh else rows
    level = measures.trust(F.col("votes"), F.col("total"), F.col("sightings"), F.col("stale"))
    return rows.withColumns(
        {
            "age_min": F.round(measures.age_minutes(F.col("last_seen"), now), 1),
            "agreement": F.round(measures.agreement(F.col("votes"), F.col("total")), 2),
            "trust": F.round(level, 2),
            "confidence": measures.trust_label(level),
        }
    )


def city(latest: DataFrame, name: str, now: Column, **how) -> DataFrame:
    return marked(latest.where(F.lower("city") == name.lower()), now, **how)


def condition(latest: DataFrame, name: str, now: Column, **how) -> DataFrame:
    return marked(latest.where(F.col("condition") == measures.condition_key(F.lit(name))), now, **how)


def roundup(latest: DataFrame, home: str, now: Column, **how) -> DataFrame:
    """Other cities' temperatures."""
    return marked(latest.where((F.col("condition") == "temperature_f") & (F.lower("city") != home.lower())), now, **how).select("city", "value", "stale")


def alerts_in_force(alerts: DataFrame, details: DataFrame, now: Column) -> DataFrame:
    """Alerts that haven't expired, labelled, with the details spoken in their life."""
    found = alerts.where(F.col("expires_at") > now).withColumn("event_label", codes.event_label(F.col("event")))
    return linking.link_details(found, details)


def forecast_periods(forecasts: DataFrame, aired: Column, now: Column, tz: str | None = None, uncertain: float = DEFAULTS.uncertain_below, stale_minutes: float = DEFAULTS.stale_minutes) -> DataFrame:
    """Each city's newest issue: a row per period with its window, ages since it was issued and last confirmed, and contested fields.

    aired: when a forecast was last heard, changed or not (null: never). Periods without a window come last.
    """
    rows = linking.latest_issuance(forecasts)
    confirmed = F.greatest("issued_at", aired)
    contested = F.array_sort(F.map_keys(F.map_filter(F.coalesce("confidence", F.create_map().cast("map<string,double>")), lambda k, v: v < uncertain)))
    age = lambda c: measures.age_minutes(F.col(c), now)
    out = rows.withColumns({"w": measures.period_window(F.col("period"), F.col("issued_at"), tz), "last_confirmed": confirmed, "uncertain": contested})
    out = out.withColumns({"valid_from": F.col("w.valid_from"), "valid_to": F.col("w.valid_to"), "age_min": F.round(age("issued_at"), 1), "confirmed_age_min": F.round(age("last_confirmed"), 1), "stale": age("last_confirmed") > stale_minutes})
    return out.drop("w").orderBy("city", F.asc_nulls_last("valid_from"), "period")


def snapshot(tables: dict[str, DataFrame], home: str, now: Column, station: str | None = None, tz: str | None = None, **how) -> DataFrame:
    """One row: the home city's conditions, the roundup, the almanac, forecast periods and alerts in force, nested.

    Of one station, or, for tables of a single one, of all rows.
    """
    of = {name: df.where(F.col("station") == station) if station is not None and "station" in df.columns else df for name, df in tables.items()}
    own, heat = F.lower("city") == home.lower(), F.col("condition") == "temperature_f"
    rows = marked(of["latest"].where(own | heat), now, **how)  # one pass over the latest view
    readings = rows.agg(
        F.array_sort(F.collect_list(F.when(own, F.struct("condition", "value", "stale", "trust", "confidence")))).alias("conditions"),
        F.array_sort(F.collect_list(F.when(~own & heat, F.struct("city", "value", "stale")))).alias("roundup"),
    )
    recaps = marked(of["almanac"], now, **{"stale_minutes": DEFAULTS.almanac_stale_minutes, **{k: v for k, v in how.items() if k != "stale_minutes"}})
    almanac = recaps.agg(F.array_sort(F.collect_list(F.struct("field", "value", "stale", "trust", "confidence"))).alias("almanac"))
    aired = of["airings"].agg(F.max("aired").alias("__aired"))  # one row
    periods = forecast_periods(of["forecasts"].crossJoin(F.broadcast(aired)), F.col("__aired"), now, tz)
    order = F.struct("city", F.col("valid_from").isNull().alias("open"), "valid_from", "period", "high_f", "low_f", "precip_pct", "sky", "valid_to", "issued_at", "confirmed_age_min", "stale", "uncertain")
    ahead = periods.agg(F.array_sort(F.collect_list(order)).alias("forecast"))
    warned = alerts_in_force(of["alerts"], of["alert_details"], now).agg(F.array_sort(F.collect_list(F.struct("event", "event_label", "counties", "areas", "expires_at", "spoken"))).alias("alerts"))
    parts = [F.broadcast(p) for p in (almanac, ahead, warned)]  # a row each
    return readings.crossJoin(parts[0]).crossJoin(parts[1]).crossJoin(parts[2]).select(F.lit(station).alias("station"), F.lit(home).alias("city"), now.alias("generated_at"), "*")


def section_counts(df: DataFrame, key: str) -> DataFrame:
    """How many rows a key has, and when it was last seen, in order of the key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("last_seen").alias("last_seen")).orderBy(key)


def distinct_cities(df: DataFrame) -> DataFrame:
    return df.select("city").distinct()


def newest_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
