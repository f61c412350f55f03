"""More named queries: store readers, scalar functions, maintenance, the replayed tables and the snapshot."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from wavetally.functions import codes, measures, params
from wavetally.functions import text as T
from wavetally.operators import bursts, dsp, folds, forecast, formats, health, maintenance, project, roster, roundup, tables, verification
from wavetally.plans import roles, store
from wavetally.plans.catalog import LATEST, ORACLES, QUERIES, READINGS, _latest, case_of, query, voted_sql
from wavetally.sources.profile import Profile

PROFILE = Profile("KJY93", 162.425, "Muncie", place_corrections={"Muncie": ["Monthsy"]}, roundup_cities=("Muncie", "Marion", "Dayton", "Lima", "Champaign"), slot_anchors={"Champaign": "Lima"}, tz="America/Indiana/Indianapolis")
RAW = "SELECT doc_id AS id, TIMESTAMP '2024-01-01' + to_minutes(doc_id::INT) AS captured_at, source AS product_type, text FROM documents"


def _raw(spark, d):
    at = F.expr("timestamp_ntz'2024-01-01'") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    return roles.load(spark, d, "documents").select(F.col("doc_id").alias("id"), at.alias("captured_at"), F.col("source").alias("product_type"), "text")


@query(f"WITH r AS ({RAW}) SELECT id, captured_at FROM r WHERE captured_at >= TIMESTAMP '2024-01-01 01:00:00' AND captured_at <= TIMESTAMP '2024-01-01 12:00:00' AND product_type = 'src3' AND text ILIKE '%the%'")
def reports_filtered(spark, d):
    at = lambda s: F.expr(f"timestamp_ntz'{s}'")
    return store.reports(_raw(spark, d), at("2024-01-01 01:00:00"), at("2024-01-01 12:00:00"), "src3", "the").select("id", "captured_at")


@query(f"WITH r AS ({RAW}) SELECT id, captured_at FROM r WHERE captured_at > TIMESTAMP '2024-01-01 02:00:00' ORDER BY captured_at, id LIMIT 25")
def reports_since(spark, d):
    return store.since(_raw(spark, d), "captured_at", F.expr("timestamp_ntz'2024-01-01 02:00:00'"), 25).select("id", "captured_at")


@query(f"WITH r AS ({RAW}) SELECT id, captured_at FROM (SELECT * FROM r ORDER BY captured_at DESC, id DESC LIMIT 30)")
def recent_reports(spark, d):
    return store.recent(_raw(spark, d), 30).select("id", "captured_at")


@query(f"WITH r AS ({RAW}) SELECT max(captured_at) AS captured_at FROM r WHERE product_type = 'src5'")
def last_airing(spark, d):
    return store.last_airing(_raw(spark, d), "src5")


@query("SELECT user_id AS station, max(ts) AS updated_at, arg_max(event_type, ts) AS state FROM events GROUP BY user_id")
def heartbeat_latest(spark, d):
    return store.heartbeat(roles.load(spark, d, "events").select(F.col("user_id").alias("station"), F.col("ts").alias("updated_at"), F.col("event_type").alias("state")))


@query(f"WITH r AS ({RAW}), a AS (SELECT id % 500 AS id, captured_at, id AS version FROM r) SELECT id, arg_max(version, (version >= 300, captured_at)) AS version FROM a GROUP BY id")
def report_upsert(spark, d):
    rows = _raw(spark, d).select((F.col("id") % 500).alias("id"), "captured_at", F.col("id").alias("version"))
    return maintenance.upsert_reports(rows.where("version < 300"), rows.where("version >= 300")).select("id", "version")


@query(LATEST + " SELECT city, condition, value, sightings FROM latest WHERE condition = 'click' AND sightings >= 2")
def condition_by_alias(spark, d):
    name = measures.condition_key(F.lit("CLICK"))
    return _latest(spark, d).where((F.col("condition") == name) & (F.col("sightings") >= 2)).select("city", "condition", "value", "sightings")


@query(LATEST + " SELECT DISTINCT city FROM latest")
def distinct_cities(spark, d):
    return store.distinct_cities(_latest(spark, d))


@query(f"WITH r AS ({READINGS}), n AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY captured_at DESC, id DESC) AS k FROM r) SELECT city, id FROM n WHERE k <= 9")
def newest_per_city(spark, d):
    return store.newest_per(roles.readings(spark, d), ["city"], [F.desc("captured_at"), F.desc("id")], 9).select("city", "id")


@query("SELECT o_orderkey, (CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_custkey % 60 END)::INT AS speed FROM orders")
def wind_speed(spark, d):
    c = F.col("o_custkey")
    phrase = F.when(c % 5 == 0, "calm").otherwise(F.concat(F.lit("west at "), (c % 60).cast("string")))
    return roles.load(spark, d, "orders").select("o_orderkey", measures.wind_speed(phrase).alias("speed"))


@query("SELECT o_orderkey, least(1500, greatest(256, (o_custkey % 40 * 60) + 24))::INT AS context, greatest(120.0, o_custkey % 40 * 30)::DOUBLE AS timeout_s FROM orders")
def stt_cost(spark, d):
    return roles.load(spark, d, "orders").select("o_orderkey", measures.stt_cost((F.col("o_custkey") % 40).cast("double")).alias("c")).select("o_orderkey", "c.context", "c.timeout_s")


@query("SELECT vec_id, 20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * x::DOUBLE))) / len(embedding))) AS rms_db, 20 * log10(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) AS peak_db FROM embeddings")
def audio_levels(spark, d):
    pcm = F.transform("embedding", lambda x: x.cast("double") * 32768.0)
    e = roles.load(spark, d, "embeddings").select("vec_id", pcm.alias("s"))
    return e.select("vec_id", measures.dbfs(F.col("s")).alias("rms_db"), measures.dbfs(F.col("s"), True).alias("peak_db"))


@query("SELECT doc_id, trim(text, E' \\t\\n') = '' OR regexp_replace(lower(text), '[^a-z0-9]', '', 'g') IN ('', 'bye', 'you', 'subscribe') AS blank FROM documents")
def blank_filter(spark, d):
    return roles.load(spark, d, "documents").select("doc_id", T.is_blank(F.col("text")).alias("blank"))


@query(f"WITH r AS ({RAW}) SELECT strftime(captured_at, '%Y-%m-%dT%H:%M:%SZ') || '-' || substr(sha1(text), 1, 6) AS id FROM r")
def report_ids(spark, d):
    return _raw(spark, d).select(T.report_id(F.col("captured_at"), F.col("text")).alias("id"))


@query("SELECT o_orderkey, [1, 2, 0, 0][(CASE WHEN p > -2 THEN 2 WHEN r < -30 AND p < -14 THEN 1 ELSE 3 END)] AS move FROM (SELECT o_orderkey, -(o_custkey % 50) AS r, -(o_orderkey % 25) AS p FROM orders)")
def gain_decision(spark, d):
    move = maintenance.gain_decision(-(F.col("o_custkey") % 50), -(F.col("o_orderkey") % 25))
    return roles.load(spark, d, "orders").select("o_orderkey", F.when(move == "raise", 1).when(move == "lower", 2).otherwise(0).alias("move"))


@query(
    """WITH e AS (SELECT user_id AS station, ts AS at, event_id AS id FROM events WHERE event_type <> 'error'), b AS (SELECT user_id AS station, ts AS burst FROM events WHERE event_type = 'error')
        SELECT id, CASE WHEN at <= burst + INTERVAL 3600 SECOND THEN 0 ELSE 10 END AS priority FROM e ASOF LEFT JOIN b ON e.station = b.station AND e.at >= b.burst""".replace(" AS at,", ' AS "at",').replace("WHEN at <=", 'WHEN "at" <=').replace("e.at", 'e."at"')
)
def alert_priority(spark, d):
    e = roles.load(spark, d, "events").select(F.col("user_id").alias("station"), F.col("ts").alias("at"), F.col("event_id").alias("id"), "event_type")
    return maintenance.alert_priority(e.where("event_type <> 'error'").drop("event_type"), e.where("event_type = 'error'").select("station", "at"), 3600).select("id", "priority")


@query("SELECT l_orderkey, median(l_quantity::DOUBLE) AS rms_median, max(l_discount) AS peak_max FROM (SELECT DISTINCT l_orderkey, l_quantity, l_discount FROM lineitem) GROUP BY l_orderkey")
def level_median(spark, d):
    s = roles.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("station"), F.concat_ws("/", "l_quantity", "l_discount").alias("segment_at"), F.col("l_quantity").cast("double").alias("dbfs"), F.col("l_discount").alias("peak"))
    return maintenance.levels(s).withColumnRenamed("station", "l_orderkey")


@query("SELECT 'floze' AS word, 'Lows' AS target, count(*) AS in_slot, count(*) FILTER (WHERE o_custkey % 7 = 0) AS outside, CASE WHEN count(*) FILTER (WHERE o_custkey % 7 = 0) > greatest(1, count(*) // 2) THEN 'context' ELSE 'safe' END AS verdict FROM orders")
def garble_proposals(spark, d):
    said = F.concat(F.lit("Floze in the lower 60s."), F.when(F.col("o_custkey") % 7 == 0, " a floze").otherwise(""))
    return maintenance.garble_proposals(roles.load(spark, d, "orders").select(said.alias("text")))


@query("SELECT o_orderkey, 'Muncie: ' || CASE WHEN o_custkey % 2 = 0 THEN 'high ' || (o_custkey % 90) || ', ' ELSE '' END || 'sunny' AS line FROM orders")
def period_lines(spark, d):
    p = F.struct(F.lit("Muncie").alias("period"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 90).alias("high_f"), F.lit(None).cast("int").alias("low_f"), F.lit("sunny").alias("sky"), F.lit(None).cast("int").alias("precip_pct"))
    return roles.load(spark, d, "orders").select("o_orderkey", formats.period_line(p).alias("line"))


SAID = """SELECT o_orderkey AS id, 'S' || (o_custkey % 40) AS station, o_orderdate + to_minutes((o_orderkey % 1440)::INT) AS captured_at, (40 + o_custkey % 50)::INT AS home, (40 + o_orderkey % 50)::INT AS town FROM orders"""


def _said(spark, d, text=None):
    """Transcripts of 40 stations out of orders, with a home temperature and a roundup of one town."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = text if text is not None else F.concat(F.lit("At Muncie, it was clear. The temperature was "), (40 + c % 50).cast("string"), F.lit(" degrees. The wind was calm. Nearby, "), (40 + k % 50).cast("string"), F.lit(" at Marion. Tonight, clear. Lows around 61."))
    at = F.col("o_orderdate") + F.make_dt_interval(mins=(k % 1440).cast("int"))
    return roles.load(spark, d, "orders").select(
        F.lpad(k.cast("string"), 12, "0").alias("id"), F.concat(F.lit("S"), (c % 40).cast("string")).alias("station"), at.alias("captured_at"), F.lit(None).cast("string").alias("type"),
        F.lit("current_conditions").alias("product_type"), text.alias("text"), F.lit(0.9).alias("avg_confidence"),
    )


SERIES = f"""SELECT id, station, captured_at, 'Muncie' AS city, 'temperature_f' AS condition, home::VARCHAR AS value FROM ({SAID}) UNION ALL SELECT id, station, captured_at, 'Marion', 'temperature_f', town::VARCHAR FROM ({SAID})
        UNION ALL SELECT id, station, captured_at, 'Muncie', 'wind', 'calm' FROM ({SAID}) UNION ALL SELECT id, station, captured_at, 'Muncie', 'wind_speed_mph', '0' FROM ({SAID}) UNION ALL SELECT id, station, captured_at, 'Muncie', 'sky', 'clear' FROM ({SAID})"""
# Ids repeat in the series, so the vote counts rows by a number of their own.
NUMBERED = f"SELECT * EXCLUDE id, id AS report, row_number() OVER (ORDER BY station, city, condition, captured_at, id) AS id FROM ({SERIES})"
REPLAYED = voted_sql("CASE WHEN a.condition = 'temperature_f' THEN 5 ELSE 15 END", 2700, "station, city, condition", NUMBERED, "captured_at, report")


@query(
    REPLAYED
    + """ SELECT station, city, condition, arg_max(voted, (captured_at, report)) AS value, arg_max(votes, (captured_at, report)) AS votes, arg_max(total, (captured_at, report)) AS total,
        count(*) AS sightings, min(captured_at) AS first_seen, max(captured_at) AS last_seen FROM voted GROUP BY station, city, condition"""
)
def replay_latest(spark, d):
    return project.replay(_said(spark, d), PROFILE)["latest"]


@query(REPLAYED + " SELECT station, captured_at, city, condition, arg_min(voted, report) AS voted, arg_min(votes, report) AS votes, arg_min(total, report) AS total FROM voted GROUP BY station, captured_at, city, condition")
def replay_history(spark, d):
    return project.replay(_said(spark, d), PROFILE)["history"].select("station", "captured_at", "city", "condition", "voted", "votes", "total")


RECAPS = """SELECT o_orderkey AS id, 'S' || (o_custkey % 40) AS station, o_orderdate + to_minutes((o_orderkey % 1440)::INT) AS captured_at, 'heating_degree_days' AS field, (o_custkey % 4)::VARCHAR AS value FROM orders"""


@query(
    voted_sql("15", None, "station, field", RECAPS)
    + """ SELECT station, field, arg_max(voted, (captured_at, id)) AS value, arg_max(votes, (captured_at, id)) AS votes, arg_max(total, (captured_at, id)) AS total, count(*) AS sightings, min(captured_at) AS first_seen, max(captured_at) AS last_seen
        FROM voted GROUP BY station, field"""
)
def replay_almanac(spark, d):
    """Each station's own almanac."""
    days = (F.col("o_custkey") % 4).cast("string")
    raw = _said(spark, d, F.concat(F.lit("There were "), days, F.lit(" heating degree days.")))
    return project.replay(raw, PROFILE)["almanac"]


@query(f"WITH s AS ({SAID}) SELECT station, min((captured_at, id)).captured_at AS captured_at, 'Tonight' AS period, 61 AS low_f, 'clear' AS sky FROM (SELECT station, captured_at, id FROM s) GROUP BY station".replace("min((captured_at, id)).captured_at", "min(captured_at)"))
def replay_forecasts(spark, d):
    return project.replay(_said(spark, d), PROFILE)["forecasts"].select("station", F.col("seq.captured_at").alias("captured_at"), "period", "low_f", "sky")


@query(f"WITH s AS ({SAID}) SELECT lpad(id::VARCHAR, 12, '0') AS id, 'Marion' AS city, town AS temp FROM s")
def roundup_hits(spark, d):
    return roundup.roundup_readings(roundup.with_cities(_said(spark, d), PROFILE), PROFILE, ["id"]).select("id", "city", "temp")


@query("SELECT n_nationkey, 'ZCZC-WXR-TOR-0180' || lpad((n_nationkey + 10)::VARCHAR, 2, '0') || '+0045-1741830-KJY93-' AS raw FROM nation")
def same_decode(spark, d):
    """Headers put into sound and read back."""

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            heads = batch.column("head").to_pylist()
            pcm = [(np.pad(dsp.encode_header(h), 400) * 30000).astype("<i2").tobytes() for h in heads]
            yield batch.append_column("pcm", pa.array(pcm, pa.binary()))

    head = F.concat(F.lit("ZCZC-WXR-TOR-0180"), F.lpad((F.col("n_nationkey") + 10).cast("string"), 2, "0"), F.lit("+0045-1741830-KJY93-"))
    n = roles.load(spark, d, "nation").select(F.col("n_nationkey"), head.alias("head")).mapInArrow(sound, "n_nationkey int, head string, pcm binary")
    return dsp.headers(n).select("n_nationkey", F.explode("raw").alias("raw"))


@query()
def fingerprint(spark, d):
    """Fingerprints of sounds made of the embeddings' values."""

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            pcm = [(np.tile(np.asarray(v, dtype=np.float64), 64) * 20000).astype("<i2").tobytes() for v in batch.column("embedding").to_pylist()]
            yield pa.record_batch([batch.column("vec_id"), pa.array(pcm, pa.binary())], names=["vec_id", "pcm"])

    e = roles.load(spark, d, "embeddings").select("vec_id", "embedding").mapInArrow(sound, "vec_id bigint, pcm binary")
    return dsp.fingerprints(e).select("vec_id", "digest")


@query()
def speech_segments(spark, d):
    """Segments where each event counts as a frame whose level its value gives."""
    e = roles.load(spark, d, "events").select(F.col("user_id").cast("string").alias("station"), F.col("event_id").alias("frame"), (F.col("value") / 10 - 50).alias("dbfs"))
    return folds.segments(e)


@query(LATEST + f" SELECT city, condition, value, epoch(TIMESTAMP '{roles.NOW}' - last_seen) / 60 > 1440 AS stale FROM latest WHERE lower(city) = 'c9' AND sightings >= 2")
def now_conditions(spark, d):
    return store.city(_latest(spark, d), "C9", roles.now(), stale_minutes=1440).select("city", "condition", "value", "stale")


@query(
    f"""WITH s AS ({SAID}) SELECT station, 'Muncie' AS city, 'Tonight' AS period, 61 AS low_f, 'clear' AS sky, min(captured_at) AS issued_at, timezone('UTC', timezone('America/Indiana/Indianapolis', local::DATE + INTERVAL 18 HOUR)) AS valid_from,
        greatest(min(captured_at), max(captured_at) FILTER (WHERE id % 3 = 0)) AS last_confirmed FROM (SELECT *, timezone('America/Indiana/Indianapolis', timezone('UTC', min(captured_at) OVER (PARTITION BY station))) AS local FROM s) GROUP BY station, local"""
)
def forecast_now(spark, d):
    """Each station's newest issue with its window and when it was last heard."""
    raw = _said(spark, d).withColumn("product_type", F.when(F.col("id").cast("bigint") % 3 == 0, "zone_forecast").otherwise(F.col("product_type")))
    t = project.replay(raw, PROFILE)
    f = t["forecasts"].join(t["airings"], "station", "left").withColumns({"town": F.col("city"), "city": F.col("station")})
    return store.forecast_periods(f, F.col("aired"), roles.now(), PROFILE.tz).select("station", F.col("town").alias("city"), "period", "low_f", "sky", "issued_at", "valid_from", "last_confirmed")


@query()
def now_snapshot(spark, d):
    """Station S7's conditions, roundup, almanac, forecast and alerts."""
    return store.snapshot(project.replay(_said(spark, d), PROFILE, station="S7"), "Muncie", roles.now(), "S7", PROFILE.tz)


@query(f"WITH c AS (SELECT o_orderkey, [{', '.join(repr(c) for c in [*codes.ORIGINATORS, 'XXX', 'wxr'])}][o_orderkey % {len(codes.ORIGINATORS) + 2} + 1] AS code FROM orders) SELECT o_orderkey, coalesce({case_of(codes.ORIGINATORS, 'upper(code)')}, code) AS label FROM c")
def originator_labels(spark, d):
    """Every originator, one that is none and one in small letters."""
    names = [*codes.ORIGINATORS, "XXX", "wxr"]
    code = F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names) + 1).cast("int"))
    return roles.load(spark, d, "orders").select("o_orderkey", codes.originator_label(code).alias("label"))


@query(f"WITH r AS (SELECT id AS report_id, captured_at, id % 900 AS key FROM ({RAW})) SELECT key, arg_max(report_id, captured_at) AS report_id, max(captured_at) AS captured_at FROM r GROUP BY key")
def detail_upsert(spark, d):
    r = _raw(spark, d).select((F.col("id") % 900).alias("key"), F.col("id").alias("report_id"), "captured_at")
    return tables.last_wins(r, ["key"], ["captured_at"]).select("key", "report_id", "captured_at")


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 1 WHEN 2 THEN 1000 ELSE greatest(1, o_custkey % 900) END::BIGINT AS page, greatest(0, o_custkey % 70 - 30)::BIGINT AS first, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE o_orderkey % 4 = 2 END AS fresh FROM orders")
def request_params(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    page = F.when(k % 5 == 0, "many").when(k % 5 == 1, "-4").when(k % 5 == 2, "1000000").otherwise((c % 900).cast("string"))
    word = F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "FALSE").when(k % 4 == 2, "1").otherwise("0")
    return roles.load(spark, d, "orders").select("o_orderkey", params.limit(page).alias("page"), params.offset((c % 70 - 30).cast("string")).alias("first"), params.flag(word, True).alias("fresh"))


@query(LATEST + " SELECT city, condition, sightings FROM latest WHERE lower(city) NOT IN ('c1', 'c2', 'c30')")
def junk_cities(spark, d):
    return roster.without_junk(_latest(spark, d), spark.createDataFrame([("c1",), ("C2",), ("C30",)], "city string")).select("city", "condition", "sightings")


@query(LATEST + " SELECT city, condition, sightings FROM latest WHERE lower(city) IN ('c1', 'c2', 'c30')")
def known_cities(spark, d):
    return roster.of_roster(_latest(spark, d), spark.createDataFrame([("c1",), ("C2",), ("C30",)], "city string")).select("city", "condition", "sightings")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::DOUBLE END AS number, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey::VARCHAR END AS words, CASE o_orderkey % 3 WHEN 0 THEN 'temperature_f' WHEN 1 THEN 'sky' ELSE 'wind_speed_mph' END AS condition FROM orders")
def value_routing(spark, d):
    """Conditions by the names in which they are asked for, and their values as numbers or words."""
    k = F.col("o_orderkey")
    condition = measures.condition_key(F.when(k % 3 == 0, "Temp").when(k % 3 == 1, "Sky").otherwise("wind_speed"))
    value = F.when(k % 3 == 2, "calm").otherwise(F.col("o_custkey").cast("string"))
    return roles.load(spark, d, "orders").select("o_orderkey", measures.number_of(condition, value).alias("number"), measures.text_of(condition, value).alias("words"), condition.alias("condition"))


@query("SELECT o_custkey % 7 AS city, o_orderdate AS issued_at, o_orderkey % 5 AS period, max(o_orderkey) AS version FROM orders GROUP BY ALL")
def forecast_upsert(spark, d):
    o = roles.load(spark, d, "orders").select(F.lit("S").alias("station"), F.struct(F.col("o_orderdate").alias("captured_at"), F.col("o_orderkey").alias("id")).alias("seq"), (F.col("o_custkey") % 7).alias("city"), (F.col("o_orderkey") % 5).alias("period"), F.col("o_orderkey").alias("version"))
    return tables.forecast_table(o).select("city", "issued_at", "period", "version")


@query(
    """SELECT user_id AS station, max(ts) AS updated_at, min(ts) AS started_at, max(ts) FILTER (WHERE event_type = 'view') AS last_segment_at, max(ts) FILTER (WHERE event_type = 'click') AS last_novel_at, max(ts) FILTER (WHERE event_type = 'signup') AS last_stt_ok_at,
        count(*) FILTER (WHERE event_type = 'view') AS segments, count(*) FILTER (WHERE event_type = 'click') AS novel, count(*) FILTER (WHERE event_type = 'error') AS stt_errors,
        greatest(0, count(*) FILTER (WHERE event_type = 'click') - count(*) FILTER (WHERE event_type IN ('signup', 'error'))) AS queue_depth FROM events GROUP BY user_id"""
)
def heartbeat_rows(spark, d):
    kind = F.col("event_type")
    e = roles.load(spark, d, "events").select(F.col("user_id").alias("station"), F.col("ts").alias("at"), F.when(kind == "view", "segment").when(kind == "click", "novel").when(kind == "signup", "stt_ok").when(kind == "error", "stt_error").otherwise("other").alias("kind"))
    return health.heartbeats(e).select("station", "updated_at", "started_at", "last_segment_at", "last_novel_at", "last_stt_ok_at", "segments", "novel", "stt_errors", "queue_depth")


@query("SELECT station, seq, raw FROM (SELECT user_id AS station, event_id AS seq, event_type AS raw, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def headers_told_once(spark, d):
    e = roles.load(spark, d, "events").select(F.col("user_id").cast("string").alias("station"), F.col("event_id").alias("seq"), F.col("event_type").alias("raw"))
    return bursts.told_once(e).withColumn("station", F.col("station").cast("bigint"))


@query("SELECT n_nationkey AS station, 'ZCZC-WXR-TOR-0180' || lpad((n_nationkey + 10)::VARCHAR, 2, '0') || '+0045-1741830-KJY93-' AS raw FROM nation")
def alert_monitor(spark, d):
    """Three bursts of each header in a stream of frames, told once."""

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for station, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                burst = np.concatenate([dsp.encode_header(head), np.zeros(8000, np.float32)])
                pcm = (np.concatenate([np.zeros(4800, np.float32), burst, burst, burst, np.zeros(40000, np.float32)]) * 30000).astype("<i2")
                frames = [pcm[i : i + 320].tobytes() for i in range(0, len(pcm) - 319, 320)]
                yield pa.record_batch([pa.array([station] * len(frames), pa.string()), pa.array(range(len(frames)), pa.int64()), pa.array(frames, pa.binary())], names=["station", "frame", "pcm"])

    head = F.concat(F.lit("ZCZC-WXR-TOR-0180"), F.lpad((F.col("n_nationkey") + 10).cast("string"), 2, "0"), F.lit("+0045-1741830-KJY93-"))
    n = roles.load(spark, d, "nation").select(F.col("n_nationkey").cast("string"), head.alias("head")).mapInArrow(sound, "station string, frame bigint, pcm binary")
    return bursts.monitored(n).select(F.col("station").cast("int").alias("station"), "raw")


def _led(spark, d):
    o = roles.load(spark, d, "orders")
    period = F.element_at(F.array(*[F.lit(p) for p in ("Today", "Tonight", "Monday", "Thursday Night")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    f = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("city"), (F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("issued_at"), period.alias("period"), (F.col("o_orderkey") % 60).cast("int").alias("high_f"), (F.col("o_custkey") % 40).cast("int").alias("low_f"), (F.col("o_orderkey") % 101).cast("int").alias("precip_pct"))
    return verification.leads(f)


LED = """f AS (SELECT o_orderkey AS id, o_custkey % 7 AS city, o_orderdate + to_hours((o_orderkey % 24)::INT) AS issued, o_orderkey % 4 AS kind, (o_orderkey % 60)::INT AS high_f, (o_custkey % 40)::INT AS low_f, (o_orderkey % 101)::INT AS precip_pct FROM orders),
        t AS (SELECT *, CASE WHEN kind < 2 THEN issued::DATE ELSE issued::DATE + CASE WHEN (w - (isodow(issued) - 1) + 7) % 7 = 0 THEN 7 ELSE (w - (isodow(issued) - 1) + 7) % 7 END::INT END AS day, kind % 2 = 1 AS night FROM (SELECT *, CASE kind WHEN 2 THEN 0 ELSE 3 END AS w FROM f)),
        led AS (SELECT *, day - issued::DATE AS lead FROM t WHERE day - issued::DATE BETWEEN 0 AND 6),
        o AS (SELECT l_suppkey % 7 AS city, l_shipdate + to_minutes((l_orderkey * 37 % 1440)::INT) AS at, l_quantity::DOUBLE AS value FROM lineitem),
        e AS (SELECT 'high' AS kind, lead, high_f - max(value) AS err FROM led JOIN o ON led.city = o.city AND o.at BETWEEN day + INTERVAL 6 HOUR AND day + INTERVAL 21 HOUR WHERE NOT night GROUP BY led.id, lead, high_f HAVING count(*) >= 6
              UNION ALL SELECT 'low', lead, low_f - min(value) FROM led JOIN o ON led.city = o.city AND o.at BETWEEN day + INTERVAL 18 HOUR AND day + INTERVAL 1950 MINUTE WHERE night GROUP BY led.id, lead, low_f HAVING count(*) >= 6)"""


def _errors(spark, d):
    return verification.temperature_errors(_led(spark, d), roles.observations(spark, d).select("city", "at", "value"))


@query("WITH " + LED + " SELECT kind, count(*) AS n, round(avg(err), 2) AS bias_f, round(avg(abs(err)), 2) AS mae_f FROM e GROUP BY kind")
def verify_highs_lows(spark, d):
    return verification.temperature_scores(_errors(spark, d))


@query("WITH " + LED + " SELECT lead::INT AS lead, round(avg(abs(err)), 2) AS mae_f FROM e GROUP BY lead")
def verify_lead_days(spark, d):
    return verification.mae_by_lead(_errors(spark, d))


@query(
    "WITH " + LED + """, tot AS (SELECT ts::DATE AS day, arg_max(event_id, ts) / 100.0::DOUBLE AS total FROM events GROUP BY 1), r AS (SELECT a.day, round(a.total - b.total, 2) AS inches FROM tot a JOIN tot b ON b.day = a.day - 1 WHERE a.total >= b.total),
        s AS (SELECT r.day, inches FROM r) SELECT count(*) AS days_measured, count(*) FILTER (WHERE inches > 0.005) AS wet_days, round(sum(inches), 2) AS total_in FROM s"""
)
def verify_rain(spark, d):
    e = roles.load(spark, d, "events").select(F.col("ts").alias("at"), (F.col("event_id") / 100.0).alias("value"))
    rain = verification.rain_by_day(e)
    return verification.rain_scores(rain, verification.rain_scorecard(_led(spark, d), rain)).select("days_measured", "wet_days", "total_in")


@query(
    """WITH o AS (SELECT o_orderkey AS id, 40 + o_custkey % 9 AS a, 45 + o_orderkey % 9 AS b FROM orders)
        SELECT id, city, temp FROM (SELECT id, 'Champaign' AS city, a AS temp FROM o UNION ALL SELECT id, 'Lima', b FROM o UNION ALL SELECT id, 'Muncie', a FROM o UNION ALL SELECT id, 'Dayton', 50 FROM o)"""
)
def roundup_slots(spark, d):
    """Names in states, an unknown one in its neighbour's slot, a known mishearing, and a city told twice."""
    a, b = ((F.lit(n) + F.col(c) % 9).cast("string") for n, c in ((40, "o_custkey"), (45, "o_orderkey")))
    said = F.concat(a, F.lit(" at Champaign, Illinois, "), b, F.lit(" at Zorblax, "), a, F.lit(" at Monthsy, 50 at Dayton Ohio and 50 at Dayton."))
    r = roles.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), said.alias("text"))
    return roundup.roundup_readings(roundup.with_cities(r, PROFILE), PROFILE, ["id"]).select("id", "city", "temp")


@query("SELECT o_orderkey AS id, 'Highs around ' || o_custkey AS text, 'Lows near ' || o_orderkey AS piece FROM orders")
def term_retrofix(spark, d):
    """Stored texts and their segments, folded again."""
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    piece = F.struct(F.lit(0.0).alias("start_s"), F.concat(F.lit("Those near "), k).alias("text"))
    r = roles.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Pies around "), c).alias("text"), F.array(piece).alias("segments"))
    return maintenance.fix_terms(r).select("id", "text", F.get("segments", F.lit(0))["text"].alias("piece"))


@query("SELECT o_orderkey AS report_id, o_orderkey % 3 = 0 AS spotter_activation FROM orders WHERE o_orderkey % 3 < 2")
def detail_predicate(spark, d):
    """Details are kept where a text has any or is an alert product."""
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, "Spotter activation is requested.").otherwise("It was clear.")
    product = F.when(k % 3 == 1, "tornado_warning").otherwise("current_conditions")
    r = roles.load(spark, d, "orders").select(F.lit("S").alias("station"), k.alias("id"), F.col("o_orderdate").alias("captured_at"), product.alias("product_type"), text.alias("text"))
    return project.detail_rows(r).select("report_id", "spotter_activation")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Thursday Night' WHEN 1 THEN 'Friday' WHEN 2 THEN 'Today' END AS before FROM orders")
def period_predecessors(spark, d):
    k = F.col("o_orderkey")
    period = F.when(k % 4 == 0, "friday").when(k % 4 == 1, "friday night").when(k % 4 == 2, "tonight").otherwise("today")
    return roles.load(spark, d, "orders").select(k.alias("id"), codes.lookup(forecast.PREDECESSORS, period).alias("before"))


@query(
    """SELECT o_orderkey AS id, 'WX BULLETIN -- KJY93 Muncie -- ' || strftime(o_orderdate, '%Y-%m-%d %H%MZ') || chr(10) || chr(10) || '** ACTIVE WARNINGS (SAME -- authoritative) **' || chr(10) || '  TORNADO WARNING -- Delaware County, IN -- until ' || strftime(o_orderdate, '%H%MZ')
        || CASE WHEN o_custkey % 2 = 0 THEN '  ** SPOTTERS ACTIVATED **' ELSE '' END || chr(10) || chr(10) || 'CURRENT (advisory -- transcribed from voice):' || chr(10) || '  Temp ' || (o_custkey % 90) || 'F  Sky clear  Wind calm' || chr(10) || chr(10) || 'FORECAST (advisory):' || chr(10) || '  Tonight: low 61, clear, rain ' || (o_orderkey % 101) || '%' || chr(10) AS bulletin,
        'WEATHER SITUATION REPORT' || chr(10) || 'Source: broadcast KJY93 (Muncie)' || chr(10) || 'Generated: ' || strftime(o_orderdate, '%Y-%m-%d %H%MZ') || chr(10) || 'NOTE: SAME alerts are authoritative; conditions/forecast are transcribed (advisory).' || chr(10) || chr(10) || '== ACTIVE WARNINGS (SAME) ==' || chr(10)
        || '- Tornado Warning | Delaware County, IN | until ' || strftime(o_orderdate, '%H%MZ') || CASE WHEN o_custkey % 2 = 0 THEN '  [SPOTTERS ACTIVATED]' ELSE '' END || chr(10) || chr(10) || '== CURRENT CONDITIONS -- Muncie ==' || chr(10) || '  Sky: clear *' || chr(10) || '  (* value past the staleness threshold)' || chr(10) || chr(10)
        || '== REGIONAL TEMPERATURES (F) ==' || chr(10) || '  Marion ' || (o_custkey % 90) || chr(10) || chr(10) || '== FORECAST ==' || chr(10) || '  Tonight: low 61, clear, rain ' || (o_orderkey % 101) || '%' || chr(10) AS report FROM orders"""
)
def bulletins(spark, d):
    """The net bulletin and the situation report."""
    at, k, c, lit = F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_custkey"), F.lit
    warned = F.array(F.struct(lit("Tornado Warning").alias("label"), F.array(lit("Delaware County, IN")).alias("counties"), F.array(lit("018035")).alias("areas"), at.alias("expires_at"), (c % 2 == 0).alias("spotters")))
    none = lit(None)
    ahead = F.array(F.struct(lit("Tonight").alias("period"), none.cast("int").alias("high_f"), lit(61).alias("low_f"), lit("clear").alias("sky"), (k % 101).cast("int").alias("precip_pct")))
    now = formats.conditions_line((c % 90).cast("double"), lit("clear"), lit("calm"), none.cast("int"), none.cast("double"), none.cast("string"))
    stale = F.create_map(lit("sky"), F.struct(lit("clear").alias("value"), lit(True).alias("stale")))
    towns = F.array(F.struct(lit("Marion").alias("city"), (c % 90).cast("double").alias("value")))
    place = (lit("KJY93"), lit("Muncie"))
    return roles.load(spark, d, "orders").select(k.alias("id"), formats.net_bulletin(*place, at, warned, now, lit(False), ahead).alias("bulletin"), formats.sitrep(*place, at, warned, stale, towns, ahead).alias("report"))


__all__ = ["ORACLES", "QUERIES"]
