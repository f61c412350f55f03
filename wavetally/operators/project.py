"""Replay: stored reports to readings, votes, history and latest views, almanac, alerts and details.

The raw reports are the source of truth; every table here is a projection that can be built again. Windows are
partitioned by station and by series, so stations and series run side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.config import DEFAULTS
from wavetally.functions import codes
from wavetally.functions import text as T
from wavetally.functions.measures import wind_speed
from wavetally.operators import forecast, observation, roundup, tables
from wavetally.operators.vote import vote, vote_conditions
from wavetally.sources.profile import Profile

#: Order of the home block's fields after the roundup's cities.
HOME_FIELDS = ("temperature_f", "dewpoint_f", "humidity_pct", "pressure_in", "pressure_trend", "wind", "sky")
ALMANAC_FIELDS = ("sunrise", "sunset", "precip_year_in", "precip_departure_in", "normal_precip_week_in", "heating_degree_days", "cooling_degree_days")


def transcripts(raw: DataFrame, profile: Profile) -> DataFrame:
    """Reports that are speech, terms folded, not blank. raw: id, station, captured_at, type, product_type, text, avg_confidence."""
    # Folding never blanks a text, so the filter runs before it.
    speech = raw.where(F.col("type").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return speech.withColumn("text", T.fold_terms(F.col("text"), profile.term_corrections))


def condition_readings(reports: DataFrame, profile: Profile, settings=DEFAULTS) -> DataFrame:
    """station, id, captured_at, pos, city, condition, value (text) in the order in which a text states them."""
    found = roundup.with_cities(tables.confident(reports, settings.confidence_floor), profile)
    reading = lambda city, condition, value: F.struct(city.alias("city"), F.lit(condition).alias("condition"), value.cast("string").alias("value"))
    towns = F.transform(roundup.town_readings(F.col("hits"), profile, settings), lambda h: reading(h["city"], "temperature_f", h["temp"]))
    spoken = F.when(~F.col("home").rlike(observation.RECAP), F.col("home"))
    home = T.once(observation.observation(spoken), lambda o: F.filter(F.array(*[reading(F.lit(profile.primary_city), f, o[f]) for f in HOME_FIELDS]), lambda r: r["value"].isNotNull()))
    rows = found.select("station", "id", "captured_at", F.posexplode(F.concat(towns, F.coalesce(home, F.array()))).alias("pos", "r"))
    return rows.select("station", "id", "captured_at", "pos", "r.*")


def voted_conditions(readings: DataFrame) -> DataFrame:
    """Every reading with its vote; a wind's vote also gives the wind speed."""
    voted = vote_conditions(readings, ["captured_at", "id", "pos"], ("station", "city", "condition"))
    speed = voted.where(F.col("condition") == "wind")
    speed = speed.withColumns({"condition": F.lit("wind_speed_mph"), "voted": wind_speed(F.col("voted")).cast("string"), "pos": F.lit(200_000)})
    return voted.unionByName(speed)


def almanac_readings(reports: DataFrame, settings=DEFAULTS) -> DataFrame:
    """station, id, captured_at, pos, field, value, with the vote over the field's last readings."""
    found = tables.confident(reports, settings.confidence_floor).select("station", "id", "captured_at", observation.almanac(F.col("text")).alias("a"))
    fields = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("value")) for i, f in enumerate(ALMANAC_FIELDS)])
    rows = found.select("station", "id", "captured_at", F.explode(fields).alias("r")).select("station", "id", "captured_at", "r.*").where(F.col("value").isNotNull())
    return vote(rows, ["station", "field"], ["captured_at", "id", "pos"], "value", depth=settings.vote_depth)


def detail_rows(reports: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Alert details of reports that have any or are alert products (low confidence doesn't matter here)."""
    products = [t.replace(" ", "_") for t in T.TITLES]
    alert = F.coalesce(F.col("product_type").isin(*products), F.lit(False))
    # The details are generated and filtered in one expression, as a filter over a column would compute them again.
    kept = F.filter(F.array(observation.alert_details(F.col("text"), aliases)), lambda d: observation.has_details(d) | alert)
    return reports.select("station", "id", "captured_at", "product_type", "text", F.explode(kept).alias("d")).select("station", F.col("id").alias("report_id"), "captured_at", "product_type", "d.*", "text")


def alert_rows(raw: DataFrame, counties: dict[str, str] | None = None) -> DataFrame:
    """Alerts out of stored headers. raw: id, captured_at, type, text (the header)."""
    parsed = raw.where(F.col("type") == "same_alert").withColumn("h", T.same_header(F.col("text")))
    out = parsed.select("id", "captured_at", "h.event", "h.areas", F.array_compact(F.transform("h.areas", lambda a: codes.county(a, counties))).alias("counties"), "h.purge_minutes", "h.issued_raw", "h.station", "h.raw")
    return tables.alerts_table(out, ["captured_at", "id"])


def replay_stats(raw: DataFrame) -> DataFrame:
    """transcripts, alerts, skipped envelopes and blank texts, in one pass."""
    kind, empty = F.col("type"), F.trim(F.coalesce("text", F.lit(""))) == ""
    return raw.agg(
        F.count_if(kind.isNull() & ~empty).alias("transcripts"),
        F.count_if(kind == "same_alert").alias("alerts"),
        F.count_if(kind.isNotNull() & (kind != "same_alert")).alias("skipped_envelope"),
        F.count_if(kind.isNull() & empty).alias("blank"),
    )


def replay(raw: DataFrame, profile: Profile, settings=DEFAULTS, station: str | None = None) -> dict[str, DataFrame]:
    """All projected tables by name; with a station, of its reports alone, as no row depends on another station's.

    The filter stands before the texts are read, because no filter moves below an Arrow function. An alert's station is
    the one in its header, so alerts come from all headers.
    """
    own = raw if station is None else raw.where(F.col("station") == station)
    reports = transcripts(own, profile)
    voted = voted_conditions(condition_readings(reports, profile, settings))
    order = ["captured_at", "id", "pos"]
    recaps = almanac_readings(reports, settings)
    in_order = tables.confident(reports, settings.confidence_floor).select("station", F.struct("captured_at", "id").alias("seq"), "text")
    return {
        "history": tables.first_wins(voted, ["station", "captured_at", "city", "condition"], ["id", "pos"]),
        "latest": tables.latest_with_sightings(voted, ["station", "city", "condition"], order),
        "almanac_history": tables.first_wins(recaps, ["station", "captured_at", "field"], ["id", "pos"]),
        "almanac": tables.latest_with_sightings(recaps, ["station", "field"], order),
        "forecasts": tables.forecast_table(forecast.project_forecasts(in_order), profile.primary_city),
        "airings": own.where(F.col("product_type") == "zone_forecast").groupBy("station").agg(F.max("captured_at").alias("aired")),
        "alerts": alert_rows(raw),
        "alert_details": tables.last_wins(detail_rows(reports, profile.aliases), ["report_id"], ["captured_at"]),
        "stats": replay_stats(own),
    }
