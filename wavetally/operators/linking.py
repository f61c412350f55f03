"""Joins over time: alert details in an alert's life, forecasts against what was observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetally.config import DEFAULTS

HOUR = 3600


def _hour(at: Column) -> Column:
    return F.floor(F.unix_seconds(at.cast("timestamp")) / HOUR)


def link_details(alerts: DataFrame, details: DataFrame, pre_buffer_s: int = DEFAULTS.alert_pre_buffer_s) -> DataFrame:
    """alerts (id, captured_at, expires_at, ...) with spoken: the ids and times of details heard from shortly
    before the alert until it expires, newest first.

    A range join by hour buckets: an alert is repeated for each hour that it covers, a detail has one hour,
    so it is an equality join and no alert meets a detail of another hour.
    """
    start = F.col("captured_at") - F.make_dt_interval(secs=F.lit(float(pre_buffer_s)).cast("decimal(18,6)"))
    end = F.coalesce("expires_at", "captured_at")
    spans = alerts.select("id", start.alias("__a"), end.alias("__b")).where("__b >= __a")
    spans = spans.withColumn("__h", F.explode(F.sequence(_hour(F.col("__a")), _hour(F.col("__b")))))
    said = details.select(F.col("report_id"), F.col("captured_at").alias("said_at"), _hour(F.col("captured_at")).alias("__h"))
    met = spans.join(said, "__h").where(F.col("said_at").between(F.col("__a"), F.col("__b")))
    lists = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("said_at", "report_id")), lambda x, y: F.when(x < y, 1).when(x > y, -1).otherwise(0)).alias("spoken"))
    return alerts.join(lists, "id", "left").withColumn("spoken", F.coalesce("spoken", F.array()))


def detail_ends(alerts: DataFrame, details: DataFrame, pre_buffer_s: int = DEFAULTS.alert_pre_buffer_s, least_of_ties: bool = False) -> DataFrame:
    """id, n, newest, oldest of each alert id: how many details link_details would list, and the ends of the list.

    No pairs are made. Both edges of an alert's life are placed among the times of details by running counts within an
    hour, on top of the counts of the hours before; an edge in an hour without details takes the nearest hour that has any.
    Of details at one time the list puts the greatest report first; least_of_ties takes the least for both ends.
    """
    start = F.col("captured_at") - F.make_dt_interval(secs=F.lit(float(pre_buffer_s)).cast("decimal(18,6)"))
    spans = alerts.select("id", start.alias("a"), F.coalesce("expires_at", "captured_at").alias("b"))
    lasts = F.coalesce(F.col("b") >= F.col("a"), F.lit(False))
    edges = spans.where(lasts).select("id", "a", "b", F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(0).alias("side")), F.struct(F.col("b").alias("t"), F.lit(2).alias("side")))).alias("e"))
    report = F.struct(F.col("captured_at").alias("said_at"), "report_id")
    last = F.min(report) if least_of_ties else F.max(report)
    said = details.where(F.col("captured_at").isNotNull()).groupBy(F.col("captured_at").alias("t")).agg(F.count(F.lit(1)).alias("c"), F.min(report).alias("lo"), last.alias("hi"))
    points = edges.select("id", "a", "b", "e.*").unionByName(said.withColumn("side", F.lit(1)), allowMissingColumns=True).withColumn("__h", _hour(F.col("t")))
    # At one time a start comes before the details and an end after them, so both bounds are inclusive.
    up, down = Window.partitionBy("__h").orderBy("t", "side"), Window.partitionBy("__h").orderBy(F.desc("t"), F.desc("side"))
    so_far = Window.unboundedPreceding, 0
    placed = points.withColumns({"in": F.coalesce(F.sum("c").over(up.rowsBetween(*so_far)), F.lit(0)), "prev": F.max("hi").over(up.rowsBetween(*so_far)), "next": F.min("lo").over(down.rowsBetween(*so_far))}).drop("c", "lo", "hi")
    per = said.groupBy(_hour(F.col("t")).alias("__h")).agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    hours = per.unionByName(edges.select(_hour(F.col("e.t")).alias("__h")).distinct(), allowMissingColumns=True)
    hours = hours.groupBy("__h").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    before, after = Window.orderBy("__h").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("__h")).rowsBetween(Window.unboundedPreceding, -1)  # over a row an hour
    hours = hours.select("__h", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.max("hi").over(before).alias("hi"), F.min("lo").over(after).alias("lo"))
    at = placed.where("side <> 1").join(hours, "__h")
    first, upto = F.col("side") == 0, F.col("base") + F.col("in")
    lives = at.groupBy("id", "a", "b").agg(
        F.sum(F.when(first, -upto).otherwise(upto)).alias("n"),
        F.max(F.when(~first, F.coalesce("prev", "hi"))).alias("newest"),
        F.min(F.when(first, F.coalesce("next", "lo"))).alias("oldest"),
    )
    some = F.col("n") > 0
    found = lives.select("id", "n", F.when(some, F.col("newest")).alias("newest"), F.when(some, F.col("oldest")).alias("oldest"))
    every = found.unionByName(spans.where(~lasts).select("id", F.lit(0).cast("long").alias("n")), allowMissingColumns=True)
    return every.groupBy("id").agg(F.sum("n").alias("n"), F.max("newest")["report_id"].alias("newest"), F.min("oldest")["report_id"].alias("oldest"))


def observed_in_windows(forecasts: DataFrame, observed: DataFrame, first_hour: float, last_hour: float) -> DataFrame:
    """Pairs of forecast rows (id, city, day) and observations (city, at, value) from day + first_hour to day + last_hour.

    All times are local without zone. The forecast's day and the next one are equality keys, so it is no theta join.
    """
    days = F.explode(F.array("day", F.date_add("day", 1))) if last_hour >= 24 else F.col("day")
    f = forecasts.select("id", "city", "day", days.alias("__d"))
    o = observed.select("city", "at", "value", F.to_date("at").alias("__d"))
    hours = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("day").cast("timestamp"))) / F.lit(3.6e9)
    return f.join(o, ["city", "__d"]).where(hours.between(first_hour, last_hour)).select("id", "value")


def window_extreme(forecasts: DataFrame, observed: DataFrame, first_hour: float, last_hour: float, highest: bool, least: int = DEFAULTS.min_window_obs) -> DataFrame:
    """forecasts (id, city, day, value) with the observed extreme of their window, where it has enough observations."""
    met = observed_in_windows(forecasts, observed, first_hour, last_hour)
    extreme = (F.max if highest else F.min)("value").alias("observed")
    found = met.groupBy("id").agg(extreme, F.count(F.lit(1)).alias("n_obs")).where(F.col("n_obs") >= least)
    return forecasts.join(found, "id")


def latest_issuance(forecasts: DataFrame) -> DataFrame:
    """The rows of each city's newest issue."""
    newest = Window.partitionBy("city")
    return forecasts.withColumn("__m", F.max("issued_at").over(newest)).where(F.col("issued_at") == F.col("__m")).drop("__m")


def modal_step(df: DataFrame, keys: list[str], step: str, least: int = DEFAULTS.min_sky_obs) -> DataFrame:
    """The most frequent step of each group with enough rows; ties to the lowest."""
    counted = df.groupBy(*keys, step).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.max_by(F.struct(F.col(step).alias("modal")), F.struct("n", (-F.col(step)).alias("low"))).alias("r"), F.sum("n").alias("n_obs")).where(F.col("n_obs") >= least).select(*keys, "r.modal", "n_obs")


def daily_difference(totals: DataFrame) -> DataFrame:
    """day, rain from running totals (day, total): the rise over the day before; a gap or a fall gives no row."""
    before = totals.select(F.date_add("day", 1).alias("day"), F.col("total").alias("before"))
    return totals.join(before, "day").where(F.col("total") >= F.col("before")).select("day", (F.col("total") - F.col("before")).alias("rain"))
