"""Known answers of the text operators over short transcripts."""

import random
from datetime import datetime, timedelta
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from wavetally.functions import codes
from wavetally.functions import text as T
from wavetally.operators import forecast, observation, project, roundup
from wavetally.plans import catalog, catalog_store, store
from wavetally.sources.profile import Profile

PROFILE = Profile(
    "KJY93", 162.425, "Muncie", place_corrections={"Muncie": ["Monthsy", "Munsee"], "Lima": ["Line"]},
    roundup_cities=("Muncie", "Anderson", "Marion", "Lima", "Dayton", "Cincinnati", "Champaign", "Indianapolis", "Louisville", "Chicago", "Lafayette"),
    slot_anchors={"Champaign": "Lima", "Dayton": "Cincinnati", "Anderson": "Indianapolis"},
    roundup_leadins={"just outside indiana": "Lima"}, term_corrections={"KJY93": ["KJ193"]}, tz="America/Indiana/Indianapolis",
)


def one(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column.alias("x")).orderBy("i").collect()
    return [r["x"].asDict(recursive=True) if hasattr(r["x"], "asDict") else r["x"] for r in rows]


def some(d):
    return {k: v for k, v in d.items() if v is not None}


def test_spoken_numbers(spark):
    assert one(spark, ["72", "sixty one", "forty-five", "banana", "", None], T.words_to_int(F.col("t"))) == [72, 61, 45, None, None, None]


def test_temperature_phrases(spark):
    cases = {"around 80": 80, "in the mid 60s": 65, "in the lower 80s": 81, "near 75": 75, "in the lower sixties": 61, "in the upper naddies": 98, "in the mid-eighties": 85, "in the 70s": 75, "hot": None}
    assert one(spark, list(cases), T.temp_phrase(F.col("t"))) == list(cases.values())


def test_clock(spark):
    assert one(spark, ["9.15pm", "6 AM", "6:14 a.m."], T.clock(F.col("t"))) == ["9:15 PM", "6:00 AM", "6:14 AM"]


def test_observation(spark):
    real, framed, garbage, spoken = (
        "At Muncie, it was clear. The temperature was 61 degrees, and the relative humidity 64%. The wind was calm. The barometric pressure was 30.16 inches and falling.",
        "Saturday, partly cloudy. Highs around 80.",
        "The temperature was 999 degrees.",
        "it was seventy two degrees. The wind was from the northwesterly at 12 miles an hour",
    )
    got = [some(o) for o in one(spark, [real, framed, garbage, spoken], observation.observation(F.col("t")))]
    assert got[0] == {"temperature_f": 61, "humidity_pct": 64, "pressure_in": 30.16, "pressure_trend": "falling", "wind": "calm", "wind_speed_mph": 0, "sky": "clear"}
    assert got[1:] == [{}, {}, {"temperature_f": 72, "wind": "northwest at 12", "wind_speed_mph": 12}]


def test_forecast_fields(spark):
    got = [some(o) for o in one(spark, ["Highs in the lower 80s. Chance of rain, eighty percent.", "near steady temperature in the upper 60s", "Lows in the mid-eighties."], observation.forecast_fields(F.col("t")))]
    assert got == [{"high_f": 81, "precip_pct": 80}, {"steady_f": 68}, {}]


def test_almanac(spark):
    texts = [
        "The total precipitation for the year now stands at 17.39 inches, which is 2.72 inches below normal. Sunset tonight is at 9.15pm. Sunrise tomorrow is at 6.14am.",
        "There were no heating degree days yesterday. This leaves 288 heating degree days. The normal precipitation total for the seven days is around 1.10 inches.",
        "There were twenty one heating degree days yesterday.",
        "At Muncie, the temperature was 76 degrees with cloudy skies.",
    ]
    got = [some(o) for o in one(spark, texts, observation.almanac(F.col("t")))]
    assert got == [
        {"sunrise": "6:14 AM", "sunset": "9:15 PM", "precip_year_in": 17.39, "precip_departure_in": -2.72},
        {"heating_degree_days": 0, "normal_precip_week_in": 1.1},
        {"heating_degree_days": 21},
        {},
    ]


def test_alert_details(spark):
    texts = [
        "Tornado warning for Delaware County until 6:15 PM. A tornado was located near Yorktown, moving northeast at 40 mph. Weather spotters are activated.",
        "Severe thunderstorm warning until 245 PM. Wind gusts up to 70 mph and quarter size hail. The storm was over Albany moving east at 35 miles per hour.",
        "At Muncie, it was clear with a temperature of 73 degrees.",
    ]
    got = one(spark, texts, observation.alert_details(F.col("t")))
    assert got[0] == {"until_text": "6:15 PM", "motion": {"direction": "northeast", "mph": 40}, "threats": ["tornado"], "locations": ["Yorktown"], "spotter_activation": True}
    assert got[1]["threats"] == ["hail quarter", "wind 70mph"] and got[1]["locations"] == ["Albany"] and got[1]["until_text"] == "245 PM"
    assert one(spark, texts, observation.has_details(observation.alert_details(F.col("t")))) == [True, True, False]


def test_term_folds(spark):
    cases = {
        "Pies around 80.": "Highs around 80.",
        "with pies in the lower 90s": "with highs in the lower 90s",
        "Chants of Brain 90% for Friday": "Chance of Rain 90% for Friday",
        "Blows in the lower 70s": "Lows in the lower 70s",
        "Close in the lower 60s.": "Lows in the lower 60s.",
        "temperatures close to normal": "temperatures close to normal",
        "The wind was eased at 7 miles an hour.": "The wind was east at 7 miles an hour.",
        "the threat eased at 7 p.m.": "the threat eased at 7 p.m.",
        "No precipitation failed yesterday.": "No precipitation fell yesterday.",
        "the warning failed": "the warning failed",
        "Chances of rain 50%": "Chance of rain 50%",
        "this is KJ193": "this is KJY93",
    }
    assert one(spark, list(cases), T.fold_terms(F.col("t"), PROFILE.term_corrections)) == list(cases.values())


def test_blank_and_loops(spark):
    texts = ["", "[BLANK_AUDIO]", "...", "Thank you.", "Tonight, clear.", None]
    assert one(spark, texts, T.is_blank(F.col("t"))) == [True, True, True, True, False, True]
    loops = ["the the the the the the", "It was It was It was It was It was It was It was", "one two", "Tonight, partly cloudy with lows in the sixties and a chance of rain late"]
    assert one(spark, loops, T.is_loop(F.col("t"))) == [True, True, False, False]


def plain_loop(text):
    words = (text or "").lower().split()
    runs = max((sum(1 for _ in g) for _, g in groupby(words)), default=0)
    return len(words) >= 3 and (runs >= 6 or (len(words) >= 12 and len(set(words)) / len(words) < 0.35))


def test_every_document_gets_a_loop_verdict(spark, tmp_path):
    """Texts of several lines, of few words and null ones too, against plain Python."""
    texts = ["\nthe the\nthe the\tthe  the\n", "It was\n" * 7, "a\u00a0a\u2003a\u3000a\x1ca\x85a", "\none two\n", " a\na\na\na\na ", "line one\nline two", "", " \n ", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.QUERIES["repetition_guard"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["loop"] for r in found} == {i: plain_loop(t) for i, t in rows} and len(found) == len(rows)
    small = "/root/testdata/sf0.001"
    found = {r["doc_id"]: r["loop"] for r in catalog.QUERIES["repetition_guard"](spark, small).collect()}
    assert found == {r["doc_id"]: plain_loop(r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_header_and_labels(spark):
    (got,) = one(spark, ["noise ZCZC-WXR-TOR-018035-018057+0045-1741830-KJY93- noise"], T.same_header(F.col("t")))
    assert got["originator"] == "WXR" and got["event"] == "TOR" and got["areas"] == ["018035", "018057"] and got["purge_minutes"] == 45 and got["station"] == "KJY93"
    assert one(spark, ["tor", "XYZ"], codes.event_label(F.col("t"))) == ["Tornado Warning", "XYZ"]
    assert one(spark, ["018035", "18035", "099999"], codes.county(F.col("t"))) == ["Delaware County, IN", None, None]
    assert one(spark, ["no header"], T.same_header(F.col("t"))) == [None]


def test_classify(spark):
    cases = {
        "A Tornado Warning is in effect.": "tornado_warning",
        "The barometric pressure was 30.16 inches": "current_conditions",
        "Nearby, 74 at Marion": "current_conditions",
        "Sunrise is at 6.14am": "almanac",
        "Tonight, clear.": "zone_forecast",
        "Slight chance of a shower": "zone_forecast",
        "Good morning": "unknown",
    }
    assert one(spark, list(cases), observation.classify(F.col("t"))) == list(cases.values())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("69 at Champaign, Illinois, 67 at Zorblax and 71 at Dayton.", {"Champaign": 69, "Lima": 67, "Dayton": 71}),
        ("Just outside Indiana, Ed Quixotle, sunny with a temperature of 73.", {"Lima": 73}),
        ("80 at Anderson, 75 at Wuzzle.", {"Anderson": 80, "Indianapolis": 75}),
        ("80 at Louisville, 75 at Wuzzle.", {"Louisville": 80, "Wuzzle": 75}),
        ("74 at Line Ohio. Marion reported 74.", {"Lima": 74, "Marion": 74}),
    ],
)
def test_city_hits(text, want):
    assert {c: t for _, c, t in roundup.city_hits(text, PROFILE)} == want


def test_outliers_need_a_quorum(spark):
    texts = ["74 at Champaign, Illinois, 72 at Dayton, 22 at Cincinnati.", "Nearby, 74 at Marion, 22 at Anderson.", "40 at Chicago, 55 at Lafayette, 68 at Louisville.", "74 at Marion. Marion reported 74."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = roundup.roundup_readings(roundup.with_cities(df, PROFILE), PROFILE, ["id"]).collect()
    got = {i: {r["city"]: r["temp"] for r in rows if r["id"] == i} for i in range(4)}
    assert got == {0: {"Champaign": 74, "Dayton": 72}, 1: {"Marion": 74, "Anderson": 22}, 2: {"Chicago": 40, "Lafayette": 55, "Louisville": 68}, 3: {"Marion": 74}}


FORECASTS = [
    (["Tonight, partly cloudy with a chance of showers.", "Lows in the lower 60s.", "Chance of rain 70 percent.", "Saturday, mostly sunny.", "Highs around 80."],
     {"Tonight": {"low_f": 61, "precip_pct": 70, "sky": "partly cloudy"}, "Saturday": {"high_f": 80, "sky": "mostly sunny"}}),
    (["for Saturday night. Partly cloudy, lows in the lower sixties, Sunday, partly cloudy. Highs in the mid 80s."],
     {"Saturday Night": {"low_f": 61, "sky": "partly cloudy"}, "Sunday": {"high_f": 85, "sky": "partly cloudy"}}),
    (["The 8 to 14 day outlook for Thursday calls for temperatures above normal."], {}),
    (["Wednesday, partly cloudy. Highs in the mid 80s.", "Highs in the mid 80s. Chance of rain 70%. Friday night, mostly cloudy. Lows in the upper 60s."],
     {"Wednesday": {"high_f": 85, "sky": "partly cloudy"}, "Friday Night": {"low_f": 68, "sky": "mostly cloudy"}}),
    (["Friday, cloudy. Highs in the mid 80s.", "Chance of rain 70%. Friday night, mostly cloudy. Lows in the upper 60s."],
     {"Friday": {"high_f": 85, "precip_pct": 70, "sky": "cloudy"}, "Friday Night": {"low_f": 68, "sky": "mostly cloudy"}}),
    (["West of today, partly cloudy. Highs in the mid 80s.", "Port tonight, partly cloudy. Lows in the mid 60s."],
     {"Rest Of Today": {"high_f": 85, "sky": "partly cloudy"}, "Tonight": {"low_f": 65, "sky": "partly cloudy"}}),
    (["For Wednesday night, mostly clear, with a near steady temperature in the upper 60s."], {"Wednesday Night": {"low_f": 68, "sky": "clear"}}),
    (["For Wednesday night, mostly clear, with a near steady temperature in the upper 80s."], {"Wednesday Night": {"sky": "clear"}}),
    (["Sunday, mostly sunny. Highs in the mid 80s."] * 5 + ["Sunday, mostly sunny. Highs in the lower 70s."], {"Sunday": {"high_f": 85, "sky": "mostly sunny"}}),
    (["Saturday, sunny. Highs in the upper 80s."] * 3 + ["Saturday, cloudy. Highs in the lower 70s."] * 10, {"Saturday": {"high_f": 71, "sky": "cloudy"}}),
]


def test_forecast_state(spark):
    """All scenarios at once, one station each."""
    rows = [(f"S{k}", i, t) for k, (texts, _) in enumerate(FORECASTS) for i, t in enumerate(texts)]
    found = forecast.project_forecasts(spark.createDataFrame(rows, "station string, seq int, text string")).collect()
    for k, (_, want) in enumerate(FORECASTS):
        own = [r for r in found if r["station"] == f"S{k}"]
        last = max((r["seq"] for r in own), default=None)
        assert {r["period"]: some({f: r[f] for f in forecast.FIELDS}) for r in own if r["seq"] == last} == want, k


def test_unchanged_votes_issue_nothing(spark):
    df = spark.createDataFrame([("S", i, "Tonight, clear. Lows in the lower 60s.") for i in range(4)], "station string, seq int, text string")
    assert {r["seq"] for r in forecast.project_forecasts(df).collect()} == {0}


def test_stale_periods_leave(spark):
    texts = ["Forecast for the Muncie area. Today, sunny. Highs in the mid 80s."] + ["Forecast for the Muncie area. Saturday, sunny. Highs in the mid 80s."] * 17
    df = spark.createDataFrame([("S", i, t) for i, t in enumerate(texts)], "station string, seq int, text string")
    rows = forecast.project_forecasts(df).collect()
    last = max(r["seq"] for r in rows)
    assert last == 16 and {r["period"] for r in rows if r["seq"] == last} == {"Saturday"}
    assert {r["city"] for r in rows} == {"Muncie"}


def plain_changes(rows, depth=15, stale=15):
    """The served map before and after each reading, as differences: (seq, key, value)."""
    pools, last, now, out = {}, {}, 0, []

    def served():
        best = {}
        for k, p in pools.items():
            if now - last[k] <= stale:
                best[k] = max(p, key=lambda v: (p.count(v), max(i for i, x in enumerate(p) if x == v)))
        return best

    for _, seq, period, field, value in rows:
        before = served()
        now += period == 0
        if value is not None:
            pools[period, field] = [*pools.get((period, field), []), value][-depth:]
            last[period, field] = now
        after = served()
        out += [(seq, *k, after.get(k)) for k in before.keys() | after.keys() if before.get(k) != after.get(k)]
    return sorted(out, key=str)


def test_changes_cover_every_series_and_staleness(spark, tmp_path):
    rnd = random.Random(4)
    kinds, start = ["click", "view", "sixth kind", "rare"], datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        kind = "rare" if i % 97 == 0 else rnd.choice(kinds[:3])
        value = None if rnd.random() < 0.05 else rnd.choice([10.0, 120.0, 130.0, 250.0])
        rows.append((i, rnd.choice([0, 6, 1, 2, 5]) if kind != "rare" else 4, kind, value, start + timedelta(minutes=11 * (i // 2))))
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, ts timestamp_ntz").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    found = [tuple(r) for r in catalog.QUERIES["change_detection"](spark, str(tmp_path)).select("seq", "period", "field", "value").collect()]
    want = plain_changes([(t, i, u % 6, k, None if v is None else int(v // 100)) for i, u, k, v, t in rows])
    assert sorted(found, key=str) == want
    assert {p for _, p, _, _ in found} == {0, 1, 2, 4, 5} and any(v is None for *_, v in found) and any(k == "sixth kind" for _, _, k, _ in found)


def test_replay(spark):
    raw = spark.createDataFrame(
        [
            ("t1", "KJY93", "2026-06-23 12:00:00", None, "current_conditions", "At Muncie, it was clear. The temperature was 70 degrees. Nearby, 74 at Marion.", 0.9),
            ("t2", "KJY93", "2026-06-23 12:10:00", None, "zone_forecast", "Tonight, clear. Lows in the lower 60s.", None),
            ("t3", "KJY93", "2026-06-23 12:20:00", None, None, "", None),
            ("t4", "KJY93", "2026-06-23 12:30:00", None, "current_conditions", "At Muncie, the temperature was 40 degrees.", 0.2),
            ("t5", "KJY93", "2026-06-23 12:40:00", None, "tornado_warning", "Tornado warning until 6:15 PM near Yorktown.", 0.1),
            ("a1", "KJY93", "2026-06-23 12:50:00", "same_alert", None, "ZCZC-WXR-RWT-018035+0600-1741830-KJY93-", None),
            ("o1", "KJY93", "2026-06-23 12:55:00", "observation", None, "x", None),
        ],
        "id string, station string, captured_at string, type string, product_type string, text string, avg_confidence double",
    ).withColumn("captured_at", F.to_timestamp_ntz("captured_at"))
    out = project.replay(raw, PROFILE)
    latest = {(r["city"], r["condition"]): (r["value"], r["sightings"]) for r in out["latest"].collect()}
    assert latest == {("Muncie", "temperature_f"): ("70", 1), ("Muncie", "sky"): ("clear", 1), ("Marion", "temperature_f"): ("74", 1)}
    assert out["stats"].first().asDict() == {"transcripts": 4, "alerts": 1, "skipped_envelope": 1, "blank": 1}
    (alert,) = out["alerts"].collect()
    assert alert["purge_minutes"] == 360 and alert["counties"] == ["Delaware County, IN"] and str(alert["expires_at"]) == "2026-06-23 18:50:00"
    assert [r["report_id"] for r in out["alert_details"].collect()] == ["t5"]
    assert [(r["period"], r["low_f"]) for r in out["forecasts"].collect()] == [("Tonight", 61)]


def test_snapshot_reads_only_its_station_before_its_texts(spark):
    """The same row as from all stations' tables; a station's filter stands below every Arrow function."""
    at = "At Muncie, it was clear. The temperature was {} degrees. Nearby, {} at Marion. Forecast for the Muncie area. Tonight, clear. Lows around {}."
    rows = [(f"r{i:03}", f"S{i % 3}", f"2024-01-30 {i // 60:02}:{i % 60:02}:00", None, "zone_forecast" if i % 5 == 0 else None, at.format(50 + i % 4, 60 + i % 3, 20 + i // 40), 0.9 if i % 7 else 0.2) for i in range(120)]
    rows += [("w1", "S1", "2024-01-30 22:00:00", None, "tornado_warning", "Tornado warning until 6:15 PM near Yorktown.", 0.9), ("w2", "S2", "2024-01-30 22:00:00", None, "tornado_warning", "Tornado warning near Gaston.", 0.9)]
    # The header of S1's alert came over another station's receiver.
    rows += [("a1", "S2", "2024-01-30 21:59:00", "same_alert", None, "ZCZC-WXR-TOR-018035+0600-0302159-S1-", None)]
    schema = "id string, station string, captured_at string, type string, product_type string, text string, avg_confidence double"
    raw = spark.createDataFrame(rows, schema).withColumn("captured_at", F.to_timestamp_ntz("captured_at"))
    now = F.to_timestamp_ntz(F.lit("2024-01-30 23:00:00"))
    own = project.replay(raw, PROFILE, station="S1")
    every = project.replay(raw, PROFILE)
    (want,) = store.snapshot(every, "Muncie", now, "S1").collect()
    (found,) = store.snapshot(own, "Muncie", now, "S1").collect()
    assert found == want and len(found["conditions"]) == 2 and len(found["forecast"]) == 1 and found["roundup"]
    assert [r["station"] for r in own["latest"].select("station").distinct().collect()] == ["S1"]
    assert own["stats"].first().asDict() == {"transcripts": 41, "alerts": 0, "skipped_envelope": 0, "blank": 0}
    assert own["alerts"].count() == every["alerts"].count()


def test_station_filter_of_the_snapshot_query(spark):
    """Below the Arrow functions of the registered query only one station's rows are left."""
    plan = catalog_store.QUERIES["now_snapshot"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    arrow = [i for i, line in enumerate(plan) if "MapInArrow" in line]
    assert arrow
    for i in arrow:
        below = [line for line in plan[i + 1 : next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(plan[i])), len(plan))]]
        assert any("Filter" in line and "S7" in line for line in below), plan[i]
