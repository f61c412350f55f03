"""Trust, age, ranges, forecast windows and levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavetally.config import DEFAULTS
from wavetally.functions.text import once

# Condition names by how they are asked for, and weekdays from Monday.
ALIASES = {
    "temperature": "temperature_f", "temp": "temperature_f", "dewpoint": "dewpoint_f", "humidity": "humidity_pct",
    "pressure": "pressure_in", "wind_speed": "wind_speed_mph",
}
TEXT_CONDITIONS = ("sky", "wind", "pressure_trend")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
DAY_NAMES = ("today", "this afternoon", "this morning", "rest of today")
NIGHT_NAMES = ("tonight", "this evening", "overnight", "rest of tonight")


def condition_key(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in ALIASES.items()], low)


def in_range(field: str, value: Column, ranges: dict | None = None) -> Column:
    """The value, or null outside the field's plausible range."""
    low, high = (ranges or DEFAULTS.ranges)[field]
    return once(value, lambda v: F.when(v.between(low, high), v))


def number_of(condition: Column, value: Column) -> Column:
    return F.when(~condition.isin(*TEXT_CONDITIONS), value.try_cast("double"))


def text_of(condition: Column, value: Column) -> Column:
    return F.when(condition.isin(*TEXT_CONDITIONS), value.cast("string"))


def agreement(votes: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.coalesce(votes, F.lit(0)) / total).otherwise(F.lit(0.0))


def trust(votes: Column, total: Column, sightings: Column, stale: Column, full: int = DEFAULTS.trust_saturation) -> Column:
    """Agreement times how often it was seen (up to full), halved when stale; not rounded."""
    seen = F.least(F.lit(1.0), F.coalesce(sightings, total, F.lit(0)) / F.lit(float(full)))
    return agreement(votes, total) * seen * F.when(stale, 0.5).otherwise(1.0)


def trust_label(value: Column, high: float = DEFAULTS.trust_high, medium: float = DEFAULTS.trust_medium) -> Column:
    rounded = F.round(value, 2)
    return F.when(rounded >= high, "high").when(rounded >= medium, "medium").otherwise("low")


def age_minutes(at: Column, now: Column) -> Column:
    """Minutes from at to now, not rounded."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(60_000_000.0)


def is_stale(at: Column, now: Column, minutes: float = DEFAULTS.stale_minutes) -> Column:
    return age_minutes(at, now) > minutes


def is_night(period: Column) -> Column:
    low = F.lower(period)
    return low.isin("tonight", "overnight", "rest of tonight") | low.endswith(" night")


def period_window(period: Column, issued: Column, tz: str | None = None) -> Column:
    """struct(valid_from, valid_to) in UTC of a forecast period, by the station's local day and clock; nulls if unknown.

    issued and the result are timestamps without zone, in UTC.
    """
    p = F.trim(F.lower(period))
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), issued) if tz else issued
    day = F.to_date(local)
    night_of = p.endswith(" night")
    name = F.when(night_of, F.trim(F.regexp_replace(p, " night$", ""))).otherwise(p)
    number = F.coalesce(*[F.when(name == w, F.lit(i)) for i, w in enumerate(WEEKDAYS)])
    ahead = F.pmod(number - F.weekday(local), F.lit(7))
    target = F.date_add(day, F.when(ahead == 0, 7).otherwise(ahead).cast("int"))
    base = F.when(p.isin(*DAY_NAMES, *NIGHT_NAMES), day).otherwise(target)
    night = p.isin(*NIGHT_NAMES) | (night_of & number.isNotNull())

    def bound(d: Column, hour: Column) -> Column:
        wall = F.to_timestamp_ntz(F.concat(d.cast("string"), F.lit(" "), hour, F.lit(":00:00")))
        return F.convert_timezone(F.lit(tz), F.lit("UTC"), wall) if tz else wall

    known = p.isin(*DAY_NAMES, *NIGHT_NAMES) | number.isNotNull()
    start = bound(base, F.when(night, "18").otherwise("06"))
    end = bound(F.when(night, F.date_add(base, 1)).otherwise(base), F.when(night, "06").otherwise("18"))
    return F.struct(F.when(known, start).alias("valid_from"), F.when(known, end).alias("valid_to"))


def wind_speed(phrase: Column) -> Column:
    """Speed of a wind phrase such as "west at 8"; 0 for any other."""
    return F.coalesce(F.regexp_extract(phrase, r" at (\d{1,3})$", 1).try_cast("int"), F.lit(0))


def dbfs(samples: Column, peak: bool = False) -> Column:
    """Level of an array of 16-bit samples against full scale; silence is -120."""
    scaled = F.transform(samples, lambda x: F.abs(x.cast("double")) / 32768.0)
    level = F.array_max(scaled) if peak else F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x * x) / F.nullif(F.size(samples), F.lit(0)))
    return F.when(level > 1e-9, 20 * F.log10(level)).otherwise(F.lit(-120.0))


def stt_cost(duration_s: Column) -> Column:
    """struct(context, timeout_s) that a transcription of this length is given."""
    context = F.greatest(F.lit(256), F.least(F.lit(1500), (duration_s * 50 * 1.2).cast("int") + 24))
    return F.struct(context.alias("context"), F.greatest(F.lit(120.0), duration_s * 30).alias("timeout_s"))
