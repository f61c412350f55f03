"""Text normalisation, spoken numbers, term folds and classification as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavetally.config import DEFAULTS
from wavetally.functions.codes import lookup

# Spoken numbers, decades (with their known mishearings) and offsets in a decade.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
TENS = "twenty thirty forty fifty sixty seventy eighty ninety"
DECADES = {
    "twenties": 20, "thirties": 30, "forties": 40, "fifties": 50, "sixties": 60, "seventies": 70, "eighties": 80, "nineties": 90,
    "naddies": 90, "netties": 90, "negies": 90, "nadies": 90, "naughties": 90, "naggies": 90,
    "aidies": 80, "aighties": 80, "eddies": 80, "adias": 80,
}
OFFSETS = {"lower": 1, "low": 1, "mid": 5, "middle": 5, "upper": 8}
PHRASE_CHARS = 30
NUMBERS = {w: i for i, w in enumerate(UNITS.split())} | {w: 10 * i for i, w in enumerate(TENS.split(), 2)}

# Words heard in place of a term, anywhere or only in a slot.
TERMS = {
    "Highs": ("Pies", "Eyes", "Hives", "Hines"),
    "Lows": ("Blows", "Flows", "Lowes", "Knows", "Ponds", "Mows"),
    "Chance": ("Chants", "Cants", "Chans"),
    "Rain": ("Brain",),
}
SLOT_TERMS = {"Lows": ("close", "those", "goes"), "Highs": ("pines",)}
SLOT = r"(?=\s+(?:in the (?:lower|low|mid|middle|upper)\b|around\s+\d|near\s+\d))"

# Titles, and phrases by which a zone forecast is known.
TITLES = ("tornado warning", "severe thunderstorm warning", "flash flood warning", "special weather statement", "hazardous weather outlook")
DIRECTIONS = "north|south|east|west|northeast|northwest|southeast|southwest"
FORECAST_PHRASES = (
    r"\bchance of (?:showers|thunderstorms?|rain|snow|flurries|precipitation)\b",
    rf"\b(?:{DIRECTIONS})(?:erly)?\s+winds?\b",
    r"\bwinds?\s+(?:around|near|becoming|light|calm|up to|\d)",
    r"\bbecoming\s+(?:mostly |partly )?(?:cloudy|clear|sunny|fair|windy)",
    r"\b(?:toward|through the late)\s+(?:daybreak|overnight|morning|afternoon|evening)",
    r"\bshowers likely\b",
    r"\bslight chance\b",
    r"\bchance of a\b",
    r"\bof (?:showers|thunderstorms?)\b",
    r"\bthunderstorms? (?:likely|possible)\b",
    r"\bin the (?:lower|mid|middle|upper)[\s-]+(?:\d{1,3}s?|\w+ies)\b",
    r"\bforecast for the\b",
    r"\bextended forecast\b",
)
# States of one word, which a heard place may end in.
STATES = (
    "Alabama Alaska Arizona Arkansas California Colorado Connecticut Delaware Florida Georgia Hawaii Idaho Illinois Indiana Iowa Kansas Kentucky "
    "Louisiana Maine Maryland Massachusetts Michigan Minnesota Mississippi Missouri Montana Nebraska Nevada Ohio Oklahoma Oregon Pennsylvania "
    "Tennessee Texas Utah Vermont Virginia Washington Wisconsin Wyoming"
)
# What silence is heard as.
STOCK_PHRASES = ("i hate it", "thank you", "thanks for watching", "please subscribe", "subscribe", "bye", "you")
SILENCE_MARKERS = ("[blank_audio]", "(dramatic music)")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match or with nothing in the group."""
    return once(F.regexp_extract(text, pattern, group), lambda got: F.when(got != "", got))


def normalise(text: Column) -> Column:
    """Lower case, only letters, digits, percent and point, single spaces."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9%. ]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def words_to_int(text: Column) -> Column:
    """Digits, or the sum of spoken units and tens; null if any word is neither."""


    def spoken(plain: Column) -> Column:
        values = F.transform(F.filter(F.split(plain, r"\s+"), lambda w: w != ""), lambda w: lookup(NUMBERS, w))
        return once(values, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0), lambda a, x: a + x)))  # a null makes the sum null

    plain = F.trim(F.replace(F.lower(text), F.lit("-"), F.lit(" ")))
    return once(plain, lambda p: F.when(p.rlike(r"^\d+$"), p.try_cast("int")).otherwise(spoken(p)))


def temp_phrase(phrase: Column) -> Column:
    """Degrees of a phrase such as "in the mid 60s" or "around 81"."""
    return once(F.substring(F.lower(phrase), 1, PHRASE_CHARS), _degrees)


def _degrees(p: Column) -> Column:
    words, offsets = "|".join(DECADES), "|".join(OFFSETS)
    part = rf"({offsets})\s+(\d{{1,3}})s"
    spelled = rf"({offsets})\s+({words})"
    return F.coalesce(
        found(p, r"(?:around|near|of)\s+(\d{1,3})").try_cast("int"),
        found(p, part, 2).try_cast("int") + lookup(OFFSETS, found(p, part, 1)),
        lookup(DECADES, found(p, spelled, 2)) + lookup(OFFSETS, found(p, spelled, 1)),
        lookup(DECADES, found(p, rf"\b({words})\b")) + 5,
        found(p, r"\b(\d{1,3})s\b").try_cast("int") + 5,
        found(p, r"\b(\d{1,3})\b").try_cast("int"),
    )


def clock(spoken: Column) -> Column:
    """"9.15pm" to "9:15 PM", "6 AM" to "6:00 AM"."""
    return once(F.lower(F.trim(spoken)), _clock)


def _clock(s: Column) -> Column:
    half = F.when(s.rlike(r"p\.?\s?m"), "PM").otherwise("AM")
    minutes = r"(\d{1,2})[:.\s]+(\d{2})"
    hour = F.coalesce(found(s, minutes, 1), found(s, r"(\d{1,2})")).try_cast("int")
    return F.concat(hour.cast("string"), F.lit(":"), F.coalesce(found(s, minutes, 2), F.lit("00")), F.lit(" "), half)


def _fold(text: Column, variants, canon: str, before: str = "", after: str = "") -> Column:
    """Each variant becomes the canonical word, its first letter's case kept."""
    words = "|".join(variants)
    upper = rf"(?-i:(?=\p{{Lu}}))(?i:{words})"
    text = F.regexp_replace(text, rf"{before}\b{upper}\b{after}", canon)
    return F.regexp_replace(text, rf"(?i){before}\b(?:{words})\b{after}", canon.lower())


def fold_terms(text: Column, own_terms: dict[str, list[str]] | None = None) -> Column:
    """Known mishearings folded to their term: everywhere, then the station's own, then in their slots."""
    for canon, variants in (TERMS | {k: tuple(v) for k, v in (own_terms or {}).items() if v}).items():
        text = _fold(text, variants, canon)
    for canon, variants in SLOT_TERMS.items():
        text = _fold(text, variants, canon, after=SLOT.replace("(?=", "(?=(?i)", 1))
    text = _fold(text, ("chances",), "Chance", after=r"(?=(?i)\s+of\s+(?:rain|showers|thunderstorms))")
    text = _fold(text, ("eased",), "East", after=r"(?=(?i)\s+(?:winds?\b|at\s+\d+\s+miles?\b))")
    return _fold(text, ("failed", "trail"), "Fell", before="(?<=(?i:precipitation ))")


def place_name(heard: Column, aliases: dict[str, str] | None = None) -> Column:
    """A capitalised place in title case, a state at its end dropped, known spellings folded. aliases: by lower-case spelling."""
    states = "|".join(STATES.split())
    name = F.regexp_replace(F.initcap(F.trim(heard)), rf"^(.+) (?:{states})$", "$1")
    return F.coalesce(lookup(aliases, F.lower(F.trim(name))), name) if aliases else name


def is_blank(text: Column) -> Column:
    """Nothing said, a marker of silence, or a stock phrase that silence is heard as."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    core = F.trim(F.regexp_replace(t, r"[^a-z0-9 ]", ""))
    return t.isin("", *SILENCE_MARKERS) | t.startswith("[blank") | core.isin("", *STOCK_PHRASES)


#: What str.split() splits at, beyond ASCII too.
WHITE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def is_loop(text: Column, run: int = DEFAULTS.repeat_run, least: int = DEFAULTS.repeat_words, ratio: float = DEFAULTS.repeat_ratio) -> Column:
    """A repetition loop: a long run of one word, or few different words among many."""
    words = F.filter(F.split(F.lower(text), WHITE), lambda w: w != "")
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, word: Column) -> Column:
        now = F.when(acc["last"] == word, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(word.alias("last"), now.alias("run"), F.greatest(acc["most"], now).alias("most"))

    longest = F.aggregate(words, start, step, lambda acc: acc["most"])
    few = (F.size(words) >= least) & (F.size(F.array_distinct(words)) / F.size(words) < ratio)
    return F.coalesce((F.size(words) >= 3) & ((longest >= run) | few), F.lit(False))


def report_id(captured_at: Column, text: Column) -> Column:
    """The stamp and the first six digits of the text's SHA-1."""
    stamp = F.date_format(captured_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat_ws("-", stamp, F.substring(F.sha1(text.cast("binary")), 1, 6))


def same_header(text: Column) -> Column:
    """The fields of a digital alert header; null without one."""
    pattern = r"ZCZC-([A-Z]{3})-([A-Z0-9]{3})((?:-\d{6})+)\+(\d{4})-(\d{7})-([\w/ ]{1,8})-?"
    part = lambda g: F.regexp_extract(text, pattern, g)
    header = F.struct(
        part(0).alias("raw"),
        part(1).alias("originator"),
        part(2).alias("event"),
        F.filter(F.split(part(3), "-"), lambda a: a != "").alias("areas"),
        (F.substring(part(4), 1, 2).try_cast("int") * 60 + F.substring(part(4), 3, 2).try_cast("int")).alias("purge_minutes"),
        part(5).alias("issued_raw"),
        F.trim(part(6)).alias("station"),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), header)
