"""Rows to text: APRS reports and bulletins, the net bulletin and the situation report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavetally.functions.codes import lookup

# Compass directions in degrees, and the pressure unit that APRS wants.
DEGREES = {"north": 0, "northeast": 45, "east": 90, "southeast": 135, "south": 180, "southwest": 225, "west": 270, "northwest": 315}
TENTH_HPA_PER_INCH = 338.639
BODY = 67
LABELS = {
    "temperature_f": "Temperature (F)", "sky": "Sky", "wind": "Wind", "humidity_pct": "Humidity (%)",
    "pressure_in": "Pressure (in)", "pressure_trend": "Pressure trend", "dewpoint_f": "Dewpoint (F)",
}


def _three(value: Column) -> Column:
    return F.coalesce(F.lpad(F.bround(value).cast("int").cast("string"), 3, "0"), F.lit("..."))


def aprs_weather(at: Column, direction: Column, speed: Column, temperature: Column, humidity: Column, pressure: Column) -> Column:
    """A positionless weather report; parts without a value are dots or left out."""
    t = F.bround(temperature).cast("int")
    degrees = F.when(t < 0, F.concat(F.lit("-"), F.lpad(F.abs(t).cast("string"), 2, "0"))).otherwise(_three(temperature))
    h = F.bround(humidity).cast("int")
    wet = F.concat(F.lit("h"), F.lpad(F.when(h >= 100, 0).otherwise(h).cast("string"), 2, "0"))
    hpa = F.concat(F.lit("b"), F.lpad(F.bround(pressure * TENTH_HPA_PER_INCH).cast("int").cast("string"), 5, "0"))
    return F.concat(
        F.lit("_"), F.date_format(at, "MMddHHmm"), F.lit("c"), _three(lookup(DEGREES, F.lower(direction))), F.lit("s"), _three(speed),
        F.lit("g...t"), degrees, F.coalesce(wet, F.lit("")), F.coalesce(hpa, F.lit("")),
    )


def hhmm(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "HHmm'Z'"), F.lit("?"))


def stamp(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd HHmm'Z'"), F.lit("?"))


def aprs_bulletin(number: Column, label: Column, area: Column, expires_at: Column, spotters: Column) -> Column:
    """One bulletin line of at most BODY characters."""
    tail = F.when(spotters, F.lit(" SPOTTERS")).otherwise("")
    body = F.substring(F.concat(label, F.lit(" "), area, F.lit(" til "), hhmm(expires_at), tail), 1, BODY)
    return F.concat(F.lit(":"), F.rpad(F.concat(F.lit("BLN"), number.cast("string"), F.lit("WX")), 9, " "), F.lit(":"), body)


def conditions_line(temperature: Column, sky: Column, wind: Column, humidity: Column, pressure: Column, trend: Column) -> Column:
    line = F.concat_ws(
        "  ",
        F.concat(F.lit("Temp "), F.bround(temperature).cast("int").cast("string"), F.lit("F")),
        F.concat(F.lit("Sky "), sky),
        F.concat(F.lit("Wind "), wind),
        F.concat(F.lit("Humidity "), F.bround(humidity).cast("int").cast("string"), F.lit("%")),
        F.trim(F.concat(F.lit("Pressure "), pressure.cast("string"), F.lit(" "), F.coalesce(trend, F.lit("")))),
    )
    return F.when(line == "", "no current data").otherwise(line)


def period_line(p: Column) -> Column:
    """p: struct(period, high_f, low_f, sky, precip_pct)."""
    parts = F.concat_ws(
        ", ",
        F.concat(F.lit("high "), p["high_f"].cast("string")),
        F.concat(F.lit("low "), p["low_f"].cast("string")),
        p["sky"],
        F.concat(F.lit("rain "), p["precip_pct"].cast("string"), F.lit("%")),
    )
    return F.concat(p["period"], F.when(parts == "", ": (no data)").otherwise(F.concat(F.lit(": "), parts)))


def _area(a: Column) -> Column:
    places = F.when(F.size(a["counties"]) > 0, a["counties"]).otherwise(a["areas"])
    return F.when(F.size(places) > 0, F.array_join(places, ", ")).otherwise("(area n/a)")


def net_bulletin(station: Column, city: Column, at: Column, alerts: Column, conditions: Column, any_stale: Column, periods: Column) -> Column:
    """alerts: array of struct(label, counties, areas, expires_at, spotters); periods: array as for period_line."""
    lines = F.transform(
        alerts,
        lambda a: F.concat(F.lit("  "), F.upper(a["label"]), F.lit(" -- "), _area(a), F.lit(" -- until "), hhmm(a["expires_at"]), F.when(a["spotters"], "  ** SPOTTERS ACTIVATED **").otherwise("")),
    )
    warned = F.when(F.size(alerts) > 0, F.concat(F.array(F.lit("** ACTIVE WARNINGS (SAME -- authoritative) **")), lines)).otherwise(F.array(F.lit("WARNINGS (SAME): NONE ACTIVE")))
    none = F.array().cast("array<string>")
    stale = F.when(any_stale, F.array(F.lit("  (* one or more readings past the staleness threshold)"))).otherwise(none)
    ahead = F.transform(F.slice(periods, 1, 4), lambda p: F.concat(F.lit("  "), period_line(p)))
    head = F.concat(F.lit("WX BULLETIN -- "), station, F.lit(" "), city, F.lit(" -- "), stamp(at))
    all_lines = F.concat(
        F.array(head, F.lit("")), warned, F.array(F.lit(""), F.lit("CURRENT (advisory -- transcribed from voice):"), F.concat(F.lit("  "), conditions)), stale, F.array(F.lit("")),
        F.when(F.size(periods) > 0, F.concat(F.array(F.lit("FORECAST (advisory):")), ahead)).otherwise(none),
    )
    return F.concat(F.array_join(all_lines, "\n"), F.lit("\n"))


def sitrep(station: Column, city: Column, at: Column, alerts: Column, readings: Column, roundup: Column, periods: Column) -> Column:
    """The fuller report. readings: map of condition to struct(value string, stale); roundup: array of struct(city, value)."""
    none = F.array().cast("array<string>")
    warned = F.transform(alerts, lambda a: F.concat(F.lit("- "), a["label"], F.lit(" | "), _area(a), F.lit(" | until "), hhmm(a["expires_at"]), F.when(a["spotters"], "  [SPOTTERS ACTIVATED]").otherwise("")))
    values = F.array_compact(
        F.array(*[F.when(F.try_element_at(readings, F.lit(c)).isNotNull(), F.concat(F.lit(f"  {label}: "), readings[c]["value"], F.when(readings[c]["stale"], " *").otherwise(""))) for c, label in LABELS.items()])
    )
    towns = F.concat(F.lit("  "), F.array_join(F.transform(roundup, lambda r: F.concat(r["city"], F.lit(" "), F.bround(r["value"]).cast("int").cast("string"))), ", "))
    lines = F.concat(
        F.array(
            F.lit("WEATHER SITUATION REPORT"), F.concat(F.lit("Source: broadcast "), station, F.lit(" ("), city, F.lit(")")), F.concat(F.lit("Generated: "), stamp(at)),
            F.lit("NOTE: SAME alerts are authoritative; conditions/forecast are transcribed (advisory)."), F.lit(""), F.lit("== ACTIVE WARNINGS (SAME) =="),
        ),
        F.when(F.size(alerts) > 0, warned).otherwise(F.array(F.lit("NONE"))),
        F.array(F.lit(""), F.concat(F.lit("== CURRENT CONDITIONS -- "), city, F.lit(" =="))),
        values,
        F.array(F.lit("  (* value past the staleness threshold)")),
        F.when(F.size(roundup) > 0, F.array(F.lit(""), F.lit("== REGIONAL TEMPERATURES (F) =="), towns)).otherwise(none),
        F.when(F.size(periods) > 0, F.concat(F.array(F.lit(""), F.lit("== FORECAST ==")), F.transform(periods, lambda p: F.concat(F.lit("  "), period_line(p))))).otherwise(none),
    )
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))
