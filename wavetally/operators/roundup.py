"""City temperatures in a roundup, in text order, with names folded and unknown ones found by their slot.

Positions decide the order and the slot, so each text is read by one Arrow-batched function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.config import DEFAULTS
from wavetally.functions import text as T
from wavetally.functions.codes import lookup
from wavetally.operators.observation import CITY
from wavetally.sources.profile import Profile

# The three phrasings (city and degrees by name), the lead-ins and the home header.
PHRASINGS = (
    rf"(?P<t>-?\d{{2,3}})\s+(?:degrees?\s+)?at\s+(?P<c>{CITY})",
    rf"\b(?P<c>{CITY})\s+reported\s+(?:at\s+)?(?P<t>-?\d{{1,3}})\b",
    rf"\b(?:[Aa]t|[Ee]d|[Ii]t|[Ii]n)\s+(?P<c>{CITY})\b(?:,\s+[A-Z][a-z]+)?[^.]*?\b[Tt]emperature of\s+(?P<t>-?\d{{1,3}})\b",
)
LEAD_IN = r"\b(?:nearby|elsewhere|just outside|other (?:locations|cities)|across (?:the|central|northern|southern|indiana))\b"
AT_TIME = r"at\s+\d{1,2}(?::\d{2})?\s*[ap]\.?\s?m\.?,?\s+(?:(?:at|it|in|ed)\s+)?"
HEADER = rf"\b(?:(?:at|it|in|ed)\s+|{AT_TIME})({CITY})\s*,?\s+(?:it (?:was|is)|the (?:temperature|sky|relative|barometric|wind|dew)|[\w\s,]{{0,40}}?(?:was|were) reported)"
LEAD_IN_CHARS = 60
STATES = frozenset(T.STATES.split())

_HITS = [re.compile(p) for p in PHRASINGS]
_LEAD, _HEADER = re.compile(LEAD_IN, re.I), re.compile(HEADER, re.I)
FOUND = "hits array<struct<pos:int,city:string,temp:int>>, home string"


def city_name(heard: str, aliases: dict[str, str]) -> str:
    """Title case, a trailing state dropped, known spellings folded."""
    words = heard.strip().title().split(" ")
    if len(words) > 1 and words[-1] in STATES:
        words.pop()
    name = " ".join(words)
    return aliases.get(name.strip().lower(), name)


def city_hits(text: str, profile: Profile) -> list[tuple[int, str, int]]:
    """(position, city, degrees) of every phrasing, in text order."""
    aliases = profile.aliases
    raw = sorted(((m.start(), m["c"], int(m["t"])) for p in _HITS for m in p.finditer(text)), key=lambda h: h[0])
    out: list[tuple[int, str, int]] = []
    for pos, heard, degrees in raw:
        city = city_name(heard, aliases)
        if profile.roundup_cities and city not in profile.roundup_cities:
            before = text[max(0, pos - LEAD_IN_CHARS) : pos].lower()
            slot = profile.slot_anchors.get(out[-1][1]) if out else None
            slot = slot or next((c for phrase, c in profile.roundup_leadins.items() if phrase.lower() in before), None)
            city = slot or city
        out.append((pos, city, degrees))
    return out


def near_peers(temps: list[int], settings=DEFAULTS) -> bool:
    """Whether any temperature stays when those far from their median go."""
    return bool(temps) and (len(temps) < settings.peer_quorum or any(abs(t - median(temps)) <= settings.peer_deviation for t in temps))


def home_block(text: str, profile: Profile, any_hits: bool) -> str | None:
    """The stretch that speaks of the station's own city: from its header to the roundup, or a text without either."""
    for m in _HEADER.finditer(text):
        if city_name(m[1], profile.aliases) == profile.primary_city:
            own = text[m.start() :]
            starts = [x.start() for x in (p.search(own) for p in (_LEAD, *_HITS)) if x]
            return own[: min(starts, default=len(own))]
    return None if any_hits else text


def with_cities(reports: DataFrame, profile: Profile, text: str = "text") -> DataFrame:
    """reports with hits (pos, city, temp) and home, the home station's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, home = [], []
            for value in batch.column(text).to_pylist():
                own = city_hits(value or "", profile)
                hits.append([{"pos": p, "city": c, "temp": t} for p, c, t in own])
                home.append(home_block(value or "", profile, near_peers([t for _, _, t in own])))
            kind = pa.list_(pa.struct([("pos", pa.int32()), ("city", pa.string()), ("temp", pa.int32())]))
            yield batch.append_column("hits", pa.array(hits, kind)).append_column("home", pa.array(home, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reports.schema.fields)
    return reports.mapInArrow(run, f"{schema}, {FOUND}")


def town_readings(hits: Column, profile: Profile, settings=DEFAULTS) -> Column:
    """array of struct(city, temp): one report's distinct readings in text order, without outliers among its peers.

    The median of a report's readings is taken inside its array, so that no rows are dealt out.
    """
    temps = F.array_sort(F.transform(hits, lambda h: h["temp"]))
    middle = (F.get(temps, F.floor((F.size(hits) - 1) / 2).cast("int")) + F.get(temps, F.floor(F.size(hits) / 2).cast("int"))) / 2
    near = T.once(middle, lambda m: F.filter(hits, lambda h: (F.size(hits) < settings.peer_quorum) | (F.abs(h["temp"] - m) <= settings.peer_deviation)))
    low, high = settings.ranges["temperature_f"]
    again = lambda city: F.coalesce(lookup(profile.aliases, F.lower(city)), city) if profile.aliases else city
    rows = F.transform(F.filter(near, lambda h: h["temp"].between(low, high)), lambda h: F.struct(again(h["city"]).alias("city"), h["temp"].alias("temp")))
    return F.array_distinct(rows)


def roundup_readings(reports: DataFrame, profile: Profile, key: list[str], settings=DEFAULTS) -> DataFrame:
    """One row per (report, city, temperature), in text order by pos."""
    rows = reports.select(*key, F.posexplode(town_readings(F.col("hits"), profile, settings)).alias("pos", "h"))
    return rows.select(*key, "h.city", "h.temp", "pos")
