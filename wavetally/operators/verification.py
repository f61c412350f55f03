"""The forecast scorecard: temperatures, sky and rain against what was observed, as one document.

Observations are reduced to a row for each local hour (extremes, counts, sky steps) before they meet forecasts, so a
city with much of everything costs its hours and not pairs of forecasts and readings. Windows begin and end on whole
hours but for one, whose last half hour is kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.config import DEFAULTS
from wavetally.functions import measures
from wavetally.functions.codes import lookup
from wavetally.operators import linking

# Sky wordings as steps of cloudiness, the windows' local hours, and the longest lead in days.
LADDER = {
    "clear": 0, "sunny": 0, "fair": 0, "mostly sunny": 1, "partly sunny": 1, "partly cloudy": 1, "mostly cloudy": 2, "cloudy": 3, "overcast": 3,
}
HIGH_HOURS, LOW_HOURS, DAY_SKY, NIGHT_SKY = (6, 21), (18, 32.5), (8, 20), (18, 30)
MOST_LEAD = 6


def local(at: Column, tz: str | None) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), at) if tz else at


def leads(forecasts: DataFrame, tz: str | None = None) -> DataFrame:
    """forecasts (city, issued_at, period, ...) with day, lead and night, those of known periods up to the longest lead.

    Times are UTC without zone; the day is the local one on which the period begins.
    """
    rows = forecasts.withColumn("__w", measures.period_window(F.col("period"), F.col("issued_at"), tz)["valid_from"]).where("__w IS NOT NULL")
    rows = rows.withColumn("day", F.to_date(local(F.col("__w"), tz)))
    rows = rows.withColumns({"lead": F.date_diff("day", F.to_date(local(F.col("issued_at"), tz))), "night": F.lower("period").contains("night")})
    return rows.where(F.col("lead").between(0, MOST_LEAD)).drop("__w")


def _hours(observed: DataFrame, tz: str | None) -> DataFrame:
    """observed (city, at, value) with its local day, the hour in it, and the part of an hour in half hours.

    A reading on a whole hour ends a window that ends there, so it gets half hours of its own."""
    at = local(F.col("at"), tz)
    micros = F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.to_date(at).cast("timestamp"))
    half = F.floor(micros / 1_800_000_000).cast("int")
    on_edge = micros % 1_800_000_000 == 0
    return observed.select("city", F.to_date(at).alias("__d"), (half * 2 + F.when(on_edge, 0).otherwise(1)).alias("__slot"), "value")


def _met(forecasts: DataFrame, slots: DataFrame, hours: tuple[float, float]) -> DataFrame:
    """forecasts (id, city, day) with the slots (city, __d, __slot, ...) of their window."""
    days = F.explode(F.array("day", F.date_add("day", 1))) if hours[1] >= 24 else F.col("day")
    near = forecasts.select("id", "city", "day", days.alias("__d")).join(slots, ["city", "__d"])
    place = F.date_diff("__d", "day") * 96 + F.col("__slot")
    return near.where(place.between(round(hours[0] * 4), round(hours[1] * 4)))


def extremes(forecasts: DataFrame, temperatures: DataFrame, hours: tuple[float, float], highest: bool, tz: str | None = None, least: int = DEFAULTS.min_window_obs) -> DataFrame:
    """id, observed: the window's extreme where it has enough observations."""
    pick = F.max if highest else F.min
    slots = _hours(temperatures, tz).groupBy("city", "__d", "__slot").agg(pick("value").alias("value"), F.count(F.lit(1)).alias("n"))
    found = _met(forecasts, slots, hours).groupBy("id").agg(pick("value").alias("observed"), F.sum("n").alias("n"))
    return found.where(F.col("n") >= least).select("id", "observed")


def sky_modes(forecasts: DataFrame, skies: DataFrame, hours: tuple[float, float], tz: str | None = None, least: int = DEFAULTS.min_sky_obs) -> DataFrame:
    """id, modal: the most frequent step of the window, ties to the lowest. skies: city, at, value (a step)."""
    slots = _hours(skies, tz).groupBy("city", "__d", "__slot", "value").agg(F.count(F.lit(1)).alias("n"))
    counted = _met(forecasts, slots, hours).groupBy("id", "value").agg(F.sum("n").alias("n"))
    best = counted.groupBy("id").agg(F.max_by("value", F.struct("n", (-F.col("value")).alias("low"))).alias("modal"), F.sum("n").alias("n"))
    return best.where(F.col("n") >= least).select("id", "modal")


def temperature_errors(led: DataFrame, temperatures: DataFrame, tz: str | None = None) -> DataFrame:
    """kind (high, low), lead, err of every day's high and night's low. led: of leads, with id."""
    parts = []
    for kind, field, hours, highest in (("high", "high_f", HIGH_HOURS, True), ("low", "low_f", LOW_HOURS, False)):
        own = led.where(F.col(field).isNotNull() & (F.col("night") != highest))
        parts.append(own.join(extremes(own, temperatures, hours, highest, tz), "id").select(F.lit(kind).alias("kind"), "lead", (F.col(field) - F.col("observed")).cast("double").alias("err")))
    return parts[0].unionByName(parts[1])


def temperature_scores(errors: DataFrame) -> DataFrame:
    """kind, n, bias_f, mae_f."""
    return errors.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("err"), 2).alias("bias_f"), F.round(F.avg(F.abs("err")), 2).alias("mae_f"))


def mae_by_lead(errors: DataFrame) -> DataFrame:
    """lead, mae_f over highs and lows."""
    return errors.groupBy("lead").agg(F.round(F.avg(F.abs("err")), 2).alias("mae_f"))


def sky_scores(led: DataFrame, skies: DataFrame, tz: str | None = None) -> DataFrame:
    """n, exact_pct, within_one_pct: one row. led: of leads, with id and sky; skies: city, at, value (wording)."""
    steps = skies.select("city", "at", lookup(LADDER, F.col("value")).alias("value")).where("value IS NOT NULL")
    said = led.withColumn("said", lookup(LADDER, F.col("sky"))).where("said IS NOT NULL")
    modes = [sky_modes(said.where("night" if night else "NOT night"), steps, hours, tz) for night, hours in ((True, NIGHT_SKY), (False, DAY_SKY))]
    off = F.abs(F.col("said") - F.col("modal"))
    n = F.count(F.lit(1))
    share = lambda hit: F.round(100.0 * F.count_if(hit) / F.nullif(n, F.lit(0)), 1)
    return said.join(modes[0].unionByName(modes[1]), "id").agg(n.alias("n"), share(off == 0).alias("exact_pct"), share(off <= 1).alias("within_one_pct"))


def rain_by_day(totals: DataFrame, tz: str | None = None) -> DataFrame:
    """day, inches: the rise of each local day's last running total (at, value) over the day before's."""
    last = totals.groupBy(F.to_date(local(F.col("at"), tz)).alias("day")).agg(F.max_by("value", "at").alias("total"))
    return linking.daily_difference(last).select("day", F.round("rain", 2).alias("inches"))


def rain_scorecard(led: DataFrame, rain: DataFrame, wet: float = DEFAULTS.wet_inches) -> DataFrame:
    """day, pop_day_before, rained, inches: each day's rain against the last chance issued the day before."""
    pops = led.where((F.col("lead") == 1) & F.col("precip_pct").isNotNull())
    before = pops.groupBy("day").agg(F.max_by(F.col("precip_pct").cast("double"), "issued_at").alias("pop_day_before"))
    return rain.join(before, "day").select("day", "pop_day_before", (F.col("inches") > wet).alias("rained"), "inches")


def rain_scores(rain: DataFrame, scorecard: DataFrame, wet: float = DEFAULTS.wet_inches) -> DataFrame:
    """days_measured, wet_days, total_in, brier_day_before, base_rate, brier_skill: one row."""
    p, o = F.col("pop_day_before") / 100, F.col("rained").cast("double")
    scored = scorecard.agg(F.avg((p - o) * (p - o)).alias("b"), F.avg(o).alias("r"))
    skill = F.round(1 - F.col("b") / F.nullif(F.col("r") * (1 - F.col("r")), F.lit(0.0)), 3)
    scored = scored.select(F.round("b", 3).alias("brier_day_before"), F.round("r", 3).alias("base_rate"), skill.alias("brier_skill"))
    days = rain.agg(F.count(F.lit(1)).alias("days_measured"), F.count_if(F.col("inches") > wet).alias("wet_days"), F.round(F.coalesce(F.sum("inches"), F.lit(0.0)), 2).alias("total_in"))
    return days.crossJoin(F.broadcast(scored))  # a row each


def scorecard(forecasts: DataFrame, observations: DataFrame, almanac: DataFrame, city: str, tz: str | None = None) -> DataFrame:
    """One row: temperature, sky and rain nested.

    forecasts: city, issued_at, period, high_f, low_f, precip_pct, sky; observations: city, condition, value, captured_at;
    almanac: field, value, captured_at.
    """
    led = leads(forecasts.where(F.col("city") == city), tz).withColumn("id", F.struct("issued_at", "period"))
    of = lambda name: observations.where((F.col("city") == city) & (F.col("condition") == name)).select("city", F.col("captured_at").alias("at"), "value")
    errors = temperature_errors(led, of("temperature_f").withColumn("value", F.col("value").try_cast("double")), tz)
    each = temperature_scores(errors)
    score = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("n", "bias_f", "mae_f")))
    heat = each.agg(score("high").alias("high"), score("low").alias("low"))
    by_lead = mae_by_lead(errors).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lead", "mae_f")))).alias("mae_by_lead_days"))
    totals = almanac.where("field = 'precip_year_in'").select(F.col("captured_at").alias("at"), F.col("value").try_cast("double").alias("value"))
    rain = rain_by_day(totals, tz)
    card = rain_scorecard(led, rain)
    days = card.agg(F.array_sort(F.collect_list(F.struct("day", "pop_day_before", "rained", "inches"))).alias("scorecard"))
    parts = [sky_scores(led, of("sky"), tz).select(F.struct("n", "exact_pct", "within_one_pct").alias("sky")), rain_scores(rain, card).crossJoin(F.broadcast(days))]
    temperature = heat.crossJoin(F.broadcast(by_lead)).select(F.struct("high", "low", "mae_by_lead_days").alias("temperature"))
    rained = parts[1].select(F.struct("days_measured", "wet_days", "total_in", "brier_day_before", "base_rate", "brier_skill", "scorecard").alias("rain"))
    return temperature.crossJoin(F.broadcast(parts[0])).crossJoin(F.broadcast(rained)).select(F.lit(city).alias("city"), F.lit(tz).alias("tz"), "*")  # a row each
