"""The zone forecast: periods out of running text, votes per period and field, issuances when the voted values change.

Splitting one text at its period headers needs positions and is an Arrow-batched function; what carries over from
text to text is closed-form windows by station: pass numbers, the open period, forward-filled votes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetally.config import DEFAULTS
from wavetally.functions import text as T
from wavetally.functions.codes import lookup
from wavetally.functions.measures import in_range, is_night
from wavetally.operators.observation import CITY, DAYS, PERIOD_HEADER, forecast_fields
from wavetally.operators.vote import vote

# What marks an outlook, a recap, a new pass, and garbled headers.
OUTLOOK = r"(?i)\b(?:outlook|(?:above|below|near)\s+normal|normal\s+(?:high|low)|degree days?|climate)\b"
RECAP = r"(?i)\b(?:once again|repeating|to repeat|here (?:is|again))\b"
AREA = rf"[Ff]orecast for (?:the )?({CITY})\s+area"
GARBLES = ((r"(?i)\bwest of (today|tonight)\b", "rest of $1"), (r"(?i)\bport (today|tonight)\b", "$1"))
BEFORE_NEAR_TERM = {
    "tonight": "Today", "this evening": "Today", "this afternoon": "Today", "rest of today": "Today",
    "overnight": "Tonight", "rest of tonight": "Tonight",
}
FIELDS = ("high_f", "low_f", "precip_pct", "sky")
NONE = "(none)"

_HEADER = re.compile(PERIOD_HEADER)
SPANS = "spans array<struct<ord:int,period:string,chunk:string>>, first_header string, last_header string, has_tail boolean"


def predecessor(period: str | None) -> str | None:
    """The period that a forecast names just before this one; None if it opens the forecast."""
    days, low = DAYS.split("|"), (period or "").lower()
    if low.endswith(" night") and low[:-6] in days:
        return low[:-6].title()
    if low in days:
        return f"{days[days.index(low) - 1].title()} Night"
    return BEFORE_NEAR_TERM.get(low)


PREDECESSORS = {p: before for d in DAYS.split("|") for p in (d, f"{d} night") if (before := predecessor(p))} | BEFORE_NEAR_TERM


def split_spans(text: str) -> list[tuple[str | None, str]]:
    """(period, chunk); a tail before the first header, or a text without one, has no period of its own."""
    marks = [(m.start(), m[1].strip().title()) for m in _HEADER.finditer(text)]
    if not marks:
        return [(None, text)]
    ends = [at for at, _ in marks[1:]] + [len(text)]
    tail = [(None, text[: marks[0][0]])] if marks[0][0] > 0 else []
    return tail + [(name, text[at:end]) for (at, name), end in zip(marks, ends, strict=True)]


def with_spans(reports: DataFrame) -> DataFrame:
    """reports (text already canonical) with spans, first_header, last_header, has_tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("ord", pa.int32()), ("period", pa.string()), ("chunk", pa.string())]))
        for batch in batches:
            cut = [split_spans(t or "") for t in batch.column("text").to_pylist()]
            named = [[p for p, _ in s if p] for s in cut]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([[{"ord": i, "period": p, "chunk": c} for i, (p, c) in enumerate(s)] for s in cut], kind),
                    pa.array([n[0] if n else None for n in named], pa.string()),
                    pa.array([n[-1] if n else None for n in named], pa.string()),
                    pa.array([bool(n) and s[0][0] is None for s, n in zip(cut, named, strict=True)], pa.bool_()),
                ],
                names=[*batch.schema.names, "spans", "first_header", "last_header", "has_tail"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reports.schema.fields)
    return reports.mapInArrow(run, f"{schema}, {SPANS}")


def canonical(text: Column) -> Column:
    for pattern, name in GARBLES:
        text = F.regexp_replace(text, pattern, name)
    return text


def passes(texts: DataFrame, station: str = "station", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """texts with pass (readouts begun so far) and the open period carried in from earlier texts.

    texts: station, seq, new_pass, clears, last_header. A text that clears starts without an open period.
    """
    w = Window.partitionBy(station).orderBy(*order)
    left = F.coalesce("last_header", F.when(F.col("clears"), F.lit(NONE)))
    out = texts.withColumn("pass", F.sum(F.col("new_pass").cast("int")).over(w))
    out = out.withColumn("__end", F.last(left, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return out.withColumn("open_period", F.when(~F.col("clears") & (F.col("__end") != NONE), F.col("__end"))).drop("__end")


def route(spans: DataFrame) -> DataFrame:
    """Votes (station, seq, ord, period, field, value, steady) of spans with their fields f.

    A night keeps no high and a day no low; a temperature without a label fills the slot that the period has.
    """
    night = is_night(F.col("period"))
    steady = F.when(night, in_range("low_f", F.col("f.steady_f"))).otherwise(F.col("f.steady_f"))
    own = F.when(night, F.col("f.low_f")).otherwise(F.col("f.high_f"))
    slot = F.when(night, F.lit("low_f")).otherwise(F.lit("high_f"))
    row = lambda field, value, is_steady: F.struct(field.alias("field"), value.cast("string").alias("value"), F.lit(is_steady).alias("steady"))
    each = F.array(
        row(slot, own, False),
        row(slot, F.when(own.isNull(), steady), True),
        row(F.lit("precip_pct"), F.col("f.precip_pct"), False),
        row(F.lit("sky"), F.col("f.sky"), False),
    )
    out = spans.select("station", "seq", "ord", "period", F.posexplode(each).alias("k", "v")).select("station", "seq", "ord", "k", "period", "v.*")
    return out.where(F.col("value").isNotNull())


def first_steady(votes: DataFrame) -> DataFrame:
    """An unlabelled temperature counts only where its key has no vote yet, that is as the key's first vote."""
    w = Window.partitionBy("station", "period", "field").orderBy("seq", "ord", "k")
    return votes.withColumn("__n", F.row_number().over(w)).where(~F.col("steady") | (F.col("__n") == 1)).drop("__n")


def served(texts: DataFrame, votes: DataFrame, depth: int = DEFAULTS.vote_depth, stale_passes: int = DEFAULTS.stale_passes) -> DataFrame:
    """For each text (station, seq, pass) and key heard so far: voted value, agreement, fresh."""
    keys = ["station", "period", "field"]
    voted = vote(votes, keys, ["seq", "ord", "k"], "value", depth=depth)
    last = voted.groupBy(*keys, "seq").agg(F.max_by(F.struct("voted", "votes", "total"), F.struct("ord", "k")).alias("r"))
    firsts = votes.groupBy(*keys).agg(F.min(F.struct("seq", F.col("ord").alias("first_ord"))).alias("since"))
    grid = texts.select("station", "seq", "pass").join(firsts, "station").where(F.col("seq") >= F.col("since.seq"))
    at = grid.join(last, [*keys, "seq"], "left")
    w = Window.partitionBy(*keys).orderBy("seq")
    at = at.withColumn("heard", F.last(F.when(F.col("r").isNotNull(), F.col("pass")), ignorenulls=True).over(w)).withColumn("r", F.last("r", ignorenulls=True).over(w))
    return at.select("station", "seq", "pass", "period", "field", "since", F.col("r.voted").alias("value"), (F.col("r.votes") / F.col("r.total")).alias("agreement"), (F.col("pass") - F.col("heard") <= stale_passes).alias("fresh"))


def issuances(texts: DataFrame, state: DataFrame) -> DataFrame:
    """(station, seq) of the texts after which the served map differs from before, with one row per period.

    Evicted keys alone change the map too. Values are compared, agreement is not.
    """
    entries = F.array_sort(F.collect_list(F.when(F.col("fresh"), F.struct("period", "field", "value", "agreement", "since"))))
    maps = state.groupBy("station", "seq").agg(entries.alias("entries"))  # all that a row needs, so the state is made once
    every = texts.select("station", "seq").join(maps, ["station", "seq"], "left")
    none = F.array().cast("array<struct<period:string,field:string,value:string>>")
    every = every.withColumn("now", F.coalesce(F.transform("entries", lambda e: F.struct(e["period"], e["field"], e["value"])), none))
    changed = every.withColumn("before", F.coalesce(F.lag("now").over(Window.partitionBy("station").orderBy("seq")), none)).where(F.col("now") != F.col("before"))
    rows = changed.select("station", "seq", F.explode("entries").alias("e")).select("station", "seq", "e.*")
    per = rows.groupBy("station", "seq", "period").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.round("agreement", 2))))).alias("confidence"),
        F.min("since").alias("since"),
    )
    get = lambda f: F.try_element_at("fields", F.lit(f))
    return per.select("station", "seq", "period", *[(get(f) if f == "sky" else get(f).cast("int")).alias(f) for f in FIELDS], "confidence", "since")


def numbered(rows: DataFrame, clock: str, order: list[str]) -> DataFrame:
    """rows (with new_pass) and pass, the readouts begun so far: a sum over hours, then windows within hours."""
    begun = F.coalesce(F.col("new_pass").cast("long"), F.lit(0))
    hour = F.floor(F.unix_micros(F.col(clock).cast("timestamp")) / 3_600_000_000)
    at = rows.withColumn("__hour", F.coalesce(hour, F.lit(-(1 << 60))))
    earlier = Window.orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)  # over a row an hour
    per = at.groupBy("__hour").agg(F.sum(begun).alias("__n"))
    per = per.select("__hour", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__hour").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = at.withColumn("__in", F.sum(begun).over(within)).join(per, "__hour")
    return out.withColumn("pass", F.col("__base") + F.col("__in")).drop("__hour", "__base", "__in")


def changes(readings: DataFrame, keys: list[str], order: list[str], value: str = "value", depth: int = DEFAULTS.vote_depth, stale_passes: int = DEFAULTS.stale_passes) -> DataFrame:
    """seq, keys, value: every change of the served map; value is null where a key goes stale.

    readings: seq, new_pass, pass, keys, value. The map changes after a reading exactly where this has rows with its seq:
    its own key is new, back from stale or of another voted value, or the pass it begins leaves keys behind.
    A null value casts no vote.
    """
    order = [*order, value, "pass"]
    w = Window.partitionBy(*keys).orderBy(*order)
    prior = F.col("pass") - F.coalesce(F.col("new_pass").cast("long"), F.lit(0))  # the pass as the reading comes in
    heard = vote(readings.where(F.col(value).isNotNull()), keys, order, value, depth=depth)
    heard = heard.withColumns({"__prior": prior, "__last": F.lag("pass").over(w), "__was": F.lag("voted").over(w), "__next": F.lead(prior).over(w)})
    own = heard.where(F.col("__last").isNull() | (F.col("__prior") - F.col("__last") > stale_passes) | (F.col("voted") != F.col("__was")))
    left = heard.where(F.col("__next").isNull() | (F.col("__next") - F.col("pass") > stale_passes))
    begins = readings.where("new_pass").select("seq", F.col("pass").alias("__at"))
    gone = left.select(*keys, (F.col("pass") + stale_passes + 1).alias("__at"), F.lit(None).cast(readings.schema[value].dataType).alias("value")).join(begins, "__at")
    return own.select("seq", *keys, F.col("voted").alias("value")).unionByName(gone.select("seq", *keys, "value"))


def project_forecasts(reports: DataFrame) -> DataFrame:
    """Issuances out of transcripts (station, seq, text): a full snapshot whenever a voted value changes."""
    # Generated and filtered in one expression, as a filter over a column would compute the text again.
    read = lambda t: F.struct(t.alias("text"), F.regexp_extract(t, AREA, 1).alias("area"), t.rlike(RECAP).alias("recap"))
    kept = T.once(canonical(F.col("text")), lambda t: F.transform(F.filter(F.array(t), lambda x: ~x.rlike(OUTLOOK)), read))
    texts = reports.select("station", "seq", F.explode(kept).alias("t")).select("station", "seq", "t.*")
    texts = texts.withColumns({"area": F.nullif("area", F.lit("")), "new_pass": F.col("area") != "", "clears": (F.col("area") != "") | F.col("recap")}).drop("recap")
    bare = passes(texts.drop("text").withColumn("last_header", F.lit(None).cast("string")))  # the passes, without splitting texts
    spans = passes(with_spans(texts.select("station", "seq", "text", "new_pass", "clears")))
    carried = lookup(PREDECESSORS, F.lower("first_header"))
    stale_tail = F.col("has_tail") & ~F.col("open_period").eqNullSafe(carried)
    each = spans.select("station", "seq", "open_period", stale_tail.alias("stale_tail"), F.explode("spans").alias("s"))
    each = each.where(~((F.col("s.ord") == 0) & F.col("stale_tail"))).select("station", "seq", "s.ord", F.coalesce("s.period", "open_period").alias("period"), forecast_fields(F.col("s.chunk")).alias("f"))
    votes = first_steady(route(each.where(F.col("period").isNotNull())))
    out = issuances(bare, served(bare, votes))
    areas = bare.select("station", "seq", F.last("area", ignorenulls=True).over(Window.partitionBy("station").orderBy("seq")).alias("city"))
    return out.join(areas, ["station", "seq"])
