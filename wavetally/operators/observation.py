"""Typed fields of one transcript: conditions, forecast fields, almanac and alert details, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavetally.functions import text as T
from wavetally.functions.measures import in_range

# The phrases that carry each field; those of conditions, forecast and almanac are matched in lower-case text.
NUMBER = r"(\d{1,3}|[a-z\- ]+?)"
SKY = "clear|sunny|fair|partly cloudy|mostly cloudy|cloudy|overcast|partly sunny|mostly sunny|fog|foggy"
TEMPERATURE = rf"(?:temperature (?:was|is|of)|it (?:was|is)) {NUMBER} degree"
DEWPOINT = rf"dew\s?point (?:was|is|of) {NUMBER}(?: degree)?"
HUMIDITY = rf"relative humidity (?:was |is |of )?{NUMBER} ?(?:percent|%)"
PRESSURE = r"(?:barometric )?pressure (?:was|is) (\d{2}\.\d{2}) inch"
TREND = r"(?:barometric )?pressure (?:was|is) \d{2}\.\d{2} inch(?=(?s:(.{0,30})))"
WIND = rf"wind (?:was|is) (?:from the )?({T.DIRECTIONS})(?:erly)? (?:at|around) (\d{{1,3}}|[a-z\- ]+?)"
OBSERVED_SKY = rf"(?:it (?:was|is)|currently|skies? (?:were|was|are|is)) ({SKY})\b"
RECAP = r"(?i)\b(climate summary|yesterday|normal\s+(?:high|low)|degree days?|record (?:high|low)|(?:high|low) temperature was)\b"
HIGH, LOW = r"\bhigh[s]?\s+([^.]*?)(?:\.|$)", r"\blow[s]?\s+([^.]*?)(?:\.|$)"
STEADY = r"temperature[s]?\s+(?:near steady\s+|steady\s+|remaining\s+)?(?:in the|near|around)\s+([^.]*?)(?:\.|$)"
RAIN_CHANCE = rf"chance of (?:rain|precipitation|showers|snow)[\s,]+{NUMBER}\s*(?:%|percent)"
ANY_SKY = rf"\b({SKY})\b"
SPOKEN_TIME = r"(\d{1,2}(?:[:.\s]\d{2})?\s*[ap]\.?\s?m\.?)"
SUNRISE, SUNSET = rf"sunrise[^.]*?\bat\s+{SPOKEN_TIME}", rf"sunset[^.]*?\bat\s+{SPOKEN_TIME}"
YEAR_RAIN = r"precipitation (?:for|from) the year\s+(?:now |still )?stands? at\s+(\d{1,3}\.\d{1,2})"
DEPARTURE = r"(\d{1,3}\.\d{1,2})\s*inch(?:es)?\s+(below|above)\s+normal"
WEEK_RAIN = r"normal precipitation total for the (?:seven days|7 days|week)\s+is\s+(?:around\s+)?(\d{1,3}\.\d{1,2})"
HEATING, COOLING = (rf"(?:were|was)\s+([\w\- ]+?)\s+{kind} degree days?" for kind in ("heating", "cooling"))
UNTIL = r"(?i)until\s+(\d{1,2}(?::\d{2})?\s*(?:[ap]\.?\s?m\.?)|\d{3,4}\s*(?:[ap]\.?\s?m\.?)|noon|midnight)"
MOTION = rf"(?i)\bmov(?:ing|ed)\s+(?:to\s+the\s+)?({T.DIRECTIONS})\s+at\s+(\d{{1,3}})\s*(?:mph|miles per hour)"
HAIL = (
    r"(?i)(\d(?:\.\d+)?)\s*inch(?:es)?\s*(?:hail|in diameter)|hail\s*(?:up to\s*|of\s*)?(\d(?:\.\d+)?)\s*inch"
    r"|(quarter|nickel|penny|ping[\s-]?pong|golf[\s-]?ball|half[\s-]?dollar|tennis[\s-]?ball|baseball)\s*[- ]?siz"
)
ALERT_WIND = r"(?i)(?:winds?|gusts?)\s*(?:up to|of|to|near|around)?\s*(\d{2,3})\s*(?:mph|miles per hour)"
CITY = r"[A-Z][a-z]+(?:\s[A-Z][a-z]+)?"
NEAR = rf"(?i:\b(?:near|over|approaching|just (?:north|south|east|west) of)\s+(?:the\s+)?)({CITY})"
SPOTTERS = (
    r"(?i)spotter activation|weather spotters?|spotters?\s+(?:are\s+|should\s+be\s+)?(?:needed|activated|encouraged|in the area|on alert)"
    r"|report(?:ing)? (?:any )?severe weather"
)
ROUNDUP = r"(?i)\b-?\d{2,3}\s+(?:degrees?\s+)?at\s+[A-Z][a-z]+"
DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
PERIOD = rf"this (?:afternoon|evening|morning)|tonight|today|overnight|rest of (?:today|tonight)|(?:{DAYS})(?:\s+night)?"
PERIOD_HEADER = rf"(?i)(?:^|[.,]\s+|\b(?:for|fore|four)\s+)({PERIOD})\b(?=[\s,.]|$)"


def _stated(low: Column, sign: str, pattern: str, group: int = 1) -> Column:
    """A group of the first match. sign: words that every match holds, so that other texts are not scanned for the pattern."""
    return F.when(low.contains(sign), T.found(low, pattern, group))


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _wind(low: Column) -> Column:
    """struct(wind, speed); both null where none is stated."""

    def blowing(said: Column) -> Column:
        fields = F.struct(T.found(said, WIND, 1).alias("d"), T.words_to_int(F.trim(T.found(said, WIND, 2))).alias("s"))
        return T.once(fields, lambda w: F.struct(F.when(w["d"].isNotNull(), F.concat_ws(" at ", w["d"], w["s"].cast("string"))).alias("wind"), w["s"].alias("speed")))

    still = F.struct(F.lit("calm").alias("wind"), F.lit(0).alias("speed"))
    return F.when(low.contains("wind was calm") | low.contains("wind is calm"), still).otherwise(T.once(_stated(low, "wind ", WIND, 0), blowing))


def _conditions(low: Column, wind: Column) -> dict[str, Column]:
    number = lambda sign, pattern: T.words_to_int(F.trim(_stated(low, sign, pattern)))
    return {
        "temperature_f": in_range("temperature_f", number(" degree", TEMPERATURE)),
        "dewpoint_f": in_range("dewpoint_f", number("dew", DEWPOINT)),
        "humidity_pct": in_range("humidity_pct", number("relative humidity", HUMIDITY)),
        "pressure_in": in_range("pressure_in", _stated(low, "pressure ", PRESSURE).try_cast("double")),
        "pressure_trend": T.found(_stated(low, "pressure ", TREND), r"\b(rising|falling|steady)\b"),
        "wind": wind["wind"],
        "wind_speed_mph": in_range("wind_speed_mph", wind["speed"]),
        "sky": T.found(low, OBSERVED_SKY),
    }


def observation(text: Column) -> Column:
    """struct of the conditions stated in a text; nulls for what it doesn't state."""
    return T.once(F.lower(text), lambda low: T.once(_wind(low), lambda wind: _struct(_conditions(low, wind))))


def _degrees(low: Column) -> dict[str, Column]:
    fields = (("high_f", "high", HIGH), ("low_f", "low", LOW), ("steady_f", "temperature", STEADY))
    return {name: in_range(name, T.temp_phrase(_stated(low, sign, pattern))) for name, sign, pattern in fields}


def _rain_chance(low: Column) -> Column:
    return in_range("precip_pct", T.words_to_int(_stated(low, "chance of ", RAIN_CHANCE)))


def forecast_fields(text: Column) -> Column:
    """struct(high_f, low_f, steady_f, precip_pct, sky) of one stretch of forecast."""

    def fields(low: Column) -> Column:
        degrees = _degrees(low)
        steady = degrees.pop("steady_f")
        rest = {"precip_pct": _rain_chance(low), "sky": T.found(low, ANY_SKY)}
        return T.once(_struct(degrees), lambda t: _struct({n: t[n] for n in degrees} | {"steady_f": F.when(t["high_f"].isNull() & t["low_f"].isNull(), steady)} | rest))

    return T.once(F.lower(text), fields)


def _almanac(low: Column) -> dict[str, Column]:
    number = lambda sign, p: _stated(low, sign, p).try_cast("double")
    days = lambda sign, p: T.once(F.trim(_stated(low, sign, p)), lambda d: F.when(d == "no", 0).otherwise(T.words_to_int(d)))
    side = F.when(_stated(low, "normal", DEPARTURE, 2) == "below", -1.0).otherwise(1.0)
    return {
        "sunrise": T.clock(_stated(low, "sunrise", SUNRISE)),
        "sunset": T.clock(_stated(low, "sunset", SUNSET)),
        "precip_year_in": in_range("precip_year_in", number("the year", YEAR_RAIN)),
        "precip_departure_in": in_range("precip_departure_in", number("normal", DEPARTURE) * side),
        "normal_precip_week_in": in_range("normal_precip_week_in", number("normal precipitation total", WEEK_RAIN)),
        "heating_degree_days": in_range("heating_degree_days", days("heating degree day", HEATING)),
        "cooling_degree_days": in_range("cooling_degree_days", days("cooling degree day", COOLING)),
    }


def almanac(text: Column) -> Column:
    """struct of the climate summary's fields."""
    return T.once(F.lower(text), lambda low: _struct(_almanac(low)))


def alert_details(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """struct(until_text, motion, threats, locations, spotter_activation) of a warning's narrative; places by their normal names."""
    until = F.regexp_replace(F.regexp_replace(F.trim(T.found(text, UNTIL)), r"\s+", " "), r"[ .]+$", "")
    size = F.coalesce(*[F.nullif(F.regexp_extract(text, HAIL, g), F.lit("")) for g in (1, 2, 3)])
    hail = F.when(size.rlike(r"^\d"), F.concat(F.lit("hail "), size, F.lit("in"))).otherwise(F.concat(F.lit("hail "), size))
    threats = F.array_compact(
        F.array(
            F.when(text.rlike(r"(?i)\btornado(?:es)?\b"), F.lit("tornado")),
            hail,
            F.concat(F.lit("wind "), T.found(text, ALERT_WIND), F.lit("mph")),
            F.when(text.rlike(r"(?i)\bflash\s+flood"), F.lit("flash flood")),
        )
    )
    motion = F.struct(F.lower(T.found(text, MOTION, 1)).alias("direction"), T.found(text, MOTION, 2).try_cast("int").alias("mph"))
    return F.struct(
        until.alias("until_text"),
        F.when(text.rlike(MOTION), motion).alias("motion"),
        threats.alias("threats"),
        F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NEAR), 1), lambda c: T.place_name(c, aliases))).alias("locations"),
        text.rlike(SPOTTERS).alias("spotter_activation"),
    )


def has_details(details: Column) -> Column:
    return details["until_text"].isNotNull() | details["motion"].isNotNull() | (F.size(details["threats"]) > 0) | (F.size(details["locations"]) > 0) | details["spotter_activation"]


def classify(text: Column) -> Column:
    """The product: a stated title, else conditions, else almanac, else forecast, else unknown."""
    return T.once(F.lower(text), _classify)


def _classify(low: Column) -> Column:
    stated = lambda fields: F.coalesce(*[c.cast("string") for c in fields]).isNotNull()  # noqa: E731  stops at the first that is
    out = F.when(low.contains(T.TITLES[0]), T.TITLES[0].replace(" ", "_"))
    for title in T.TITLES[1:]:
        out = out.when(low.contains(title), title.replace(" ", "_"))
    conditions = _conditions(low, _wind(low))
    seen = stated(conditions[n] for n in ("pressure_in", "temperature_f", "dewpoint_f", "humidity_pct", "wind", "sky"))
    recap = stated(_almanac(low).values())
    degrees = _degrees(low)
    ahead = low.rlike(PERIOD_HEADER) | stated([*degrees.values(), _rain_chance(low)])
    phrases = low.rlike("(?i)" + "|".join(T.FORECAST_PHRASES))
    return out.when(seen | low.rlike(ROUNDUP), "current_conditions").when(recap, "almanac").when(ahead | phrases, "zone_forecast").otherwise("unknown")
