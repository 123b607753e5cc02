"""Streaming queries, replayed over the driver's event table (N, C19, C20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import theta
from ..operators import joins as jn, lookup as lk, reshape as rs
from ..operators.patterns import micros
from ..session import materialise, new_path
from ..sources.tables import lay_out, stream_files
from ..streaming import alerts as al, decisions as dc, joins as sj, lexicon as lx, operators as st
from ..streaming.run import replay
from . import base as b
from .registry import load, query

R = lambda c, n=6: F.round(c, n)


#: The archive is replayed in files in time order, so many in a micro-batch.
FILES, PER_TRIGGER = 6, 2


def stream(spark, d, where="true", path=None):
    """The event table as a stream, laid out in time order and read a few files at a time."""
    e = load(spark, d, "events")
    if path is None:
        path = new_path(spark, "events")
        lay_out(e, "ts", path, FILES)
    s = stream_files(spark, path, e.schema, per_trigger=PER_TRIGGER).where(where)
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "station").withColumn("us", micros("ts"))


def two_streams(spark, d, left, right):
    """Two streams over one laid-out archive."""
    path = new_path(spark, "events")
    lay_out(load(spark, d, "events"), "ts", path, FILES)
    return stream(spark, d, left, path), stream(spark, d, right, path)


WM = "(SELECT epoch_us(date_trunc('millisecond', max(ts))) FROM events)"


@query("n01_tumble", f"""SELECT epoch_us(date_trunc('hour', ts)) AS start_us, user_id AS station, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2
HAVING epoch_us(date_trunc('hour', ts)) + 3600000000 <= {WM} - 600000000""")
def _(spark, d):
    t = replay(st.tumble(stream(spark, d), "ts", "1 hour", "10 minutes", ["station"], mean=F.avg("value"), n=F.count(F.lit(1))))
    return t.select(micros("start").alias("start_us"), "station", R("mean").alias("mean"), "n")


@query("n02_slide", f"""WITH x AS (SELECT epoch_us(date_trunc('day', ts)) - k * 86400000000 AS start_us, event_type, value FROM events, range(7) r(k))
SELECT CAST(start_us AS BIGINT) AS start_us, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM x WHERE start_us + 7 * 86400000000 <= {WM} - 600000000 GROUP BY 1, 2""")
def _(spark, d):
    t = replay(st.slide(stream(spark, d), "ts", "7 days", "1 day", "10 minutes", ["event_type"], mean=F.avg("value"), n=F.count(F.lit(1))))
    return t.select(micros("start").alias("start_us"), "event_type", R("mean").alias("mean"), "n")


def flags(spark, d):
    """Daily flags per station: a station has one row per day, so its state stays in time order."""
    p = b.daily_panel(spark, d)
    return p.select("station", "t", F.coalesce((F.col("stage") >= 30).cast("int"), F.lit(0)).alias("flag"), F.col("day").cast("timestamp").alias("ts"))


FLAGS = b.DAILY_PANEL + ", raw AS (SELECT station AS entity, 1 AS thr, t, CAST(coalesce(stage >= 30, false) AS INTEGER) AS flag FROM dpanel)"
RUNS = """, chg AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER (PARTITION BY entity ORDER BY t) THEN 1 ELSE 0 END AS c FROM raw),
isl AS (SELECT *, sum(c) OVER (PARTITION BY entity ORDER BY t) AS rid FROM chg),
flagged AS (SELECT entity, thr, t, CAST(flag = 1 AND count(*) OVER (PARTITION BY entity, rid) >= 2 AS INTEGER) AS flag FROM isl)"""


DAY_END = "(SELECT max(t) FROM dpanel)"


@query("n03_alert_state", "WITH RECURSIVE " + FLAGS + RUNS + b.onset_sql(r=5) + f" SELECT CAST(entity AS BIGINT) AS station, CAST(t AS BIGINT) AS onset_t FROM onsets WHERE onset = 1 AND t + 2 <= {DAY_END}")
def _(spark, d):
    """Daily flags in event time; the last day is not behind the watermark yet."""
    f = flags(spark, d)
    path = new_path(spark, "flags")
    lay_out(f, "ts", path, FILES)
    own = al.state_session(spark)
    alerts = al.onset_alerts(stream_files(own, path, f.schema, per_trigger=PER_TRIGGER), "ts", "1 day", 2, 5)
    return replay(alerts, reader=spark)


@query("n04_sessions", f"""WITH l AS (SELECT user_id AS station, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pu, value FROM events),
s AS (SELECT *, sum(CASE WHEN pu IS NULL OR us - pu >= 6 * 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM l)
SELECT station, min(us) AS start_us, count(*) AS items, round(max(value), 6) AS top FROM s GROUP BY station, sid HAVING max(us) + 6 * 3600000000 <= {WM} - 600000000""")
def _(spark, d):
    t = replay(st.sessions(stream(spark, d), "ts", "6 hours", "10 minutes", ["station"], items=F.count(F.lit(1)), top=F.max("value")))
    return t.select("station", micros("start").alias("start_us"), "items", R("top").alias("top"))


@query("n05_enrich", "SELECT event_id, user_id AS station, c_mktsegment AS segment FROM events LEFT JOIN customer ON c_custkey = user_id")
def _(spark, d):
    dim = load(spark, d, "customer").select(F.col("c_custkey").alias("station"), F.col("c_mktsegment").alias("segment"))
    return replay(st.enrich(stream(spark, d), dim, ["station"])).select("event_id", "station", "segment")


STATE = """u AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type IN ('view', 'purchase', 'signup')), s AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type IN ('error', 'click')),
ws AS (SELECT u.event_id, u.user_id AS station, CASE WHEN u.ts - s.ts <= INTERVAL 2 DAY THEN s.event_id END AS state_event_id, CASE WHEN u.ts - s.ts <= INTERVAL 2 DAY THEN s.value END AS state_value
  FROM u ASOF LEFT JOIN s ON u.user_id = s.user_id AND u.ts >= s.ts)"""


@query("n06_with_state", "WITH " + STATE + " SELECT * FROM ws")
def _(spark, d):
    s = stream(spark, d, "event_type IN ('view', 'purchase', 'signup', 'error', 'click')").select("event_id", "station", "us", "event_type", "value")
    is_state = F.col("event_type").isin("error", "click")
    out = st.with_state(s, is_state, ["station"], "us", "event_id", "value", 2 * 86400e6)
    return out.select("event_id", "station", "state_event_id", "state_value")


BEHIND = """least((SELECT epoch_us(date_trunc('millisecond', max(ts))) FROM events WHERE {0}), (SELECT epoch_us(date_trunc('millisecond', max(ts))) FROM events WHERE {1})) - 600000000 - {2} * 86400000000"""


@query("n06_state_join", "WITH " + STATE + " SELECT ws.* FROM ws JOIN events e ON e.event_id = ws.event_id WHERE epoch_us(e.ts) <= "
       + BEHIND.format("event_type IN ('view', 'purchase', 'signup')", "event_type IN ('error', 'click')", 2))
def _(spark, d):
    """Utterances and states as two streams joined in event time; events come out two days behind the watermark, as far as a state reaches."""
    u, s = two_streams(spark, d, "event_type IN ('view', 'purchase', 'signup')", "event_type IN ('error', 'click')")
    out = sj.latest_state(u.select("event_id", "station", "ts"), s.select("event_id", "station", "ts", "value"), ["station"], "ts", "event_id", "2 DAYS", "10 minutes", ["value"])
    return replay(out).select("event_id", "station", "state_event_id", "state_value")


# --- utterances and the lexicon ------------------------------------------------------------------


def utterances(e):
    """Spoken commands: the phrase follows from the event's own props, odd events lose the last letter."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    phrase = F.element_at(F.array(*map(F.lit, lx.PHRASES)), (F.pmod(k, F.lit(len(lx.PHRASES))) + 1).cast("int"))
    said = F.when(F.pmod("event_id", F.lit(2)) == 1, F.expr("substring(phrase0, 1, length(phrase0) - 1)")).otherwise(F.col("phrase0"))
    u = e.withColumn("phrase0", phrase).withColumn("phrase", said)
    return u.select(
        "event_id", "station", "us", F.col("station").alias("home"), "phrase", F.element_at(F.array(*map(F.lit, lx.ROOMS)), (F.pmod("event_id", F.lit(3)) + 1).cast("int")).alias("room"),
        (F.col("value") / 10).alias("snr"), (F.col("value") / (F.col("value") + 50)).alias("conf"), "event_type")


PH = "[" + ", ".join(f"'{p}'" for p in lx.PHRASES) + "]"
MT = ", ".join(f"('{f}', '{'active' if f == g else 'defensive'}', '{e}')" for f in lx.FAMILIES for g in lx.FAMILIES for e in lx.LEXICON[g] if f == g or e not in lx.LEXICON[f])
UTT = f"""p0 AS (SELECT *, {PH}[CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % {len(lx.PHRASES)} + 1 AS INTEGER)] AS ph FROM events),
utt AS (SELECT event_id, user_id AS home, ts, CASE WHEN event_id % 2 = 1 THEN substr(ph, 1, length(ph) - 1) ELSE ph END AS phrase, ['living room', 'kitchen', 'bedroom'][CAST(event_id % 3 + 1 AS INTEGER)] AS room,
  value / 10 AS snr, value / (value + 50) AS conf, event_type FROM p0),
lex AS (SELECT * FROM (VALUES {MT}) v(family, kind, entry)),
said AS (SELECT DISTINCT phrase FROM utt),
cd AS (SELECT phrase, family, kind, entry FROM said, lex),
bst AS (SELECT phrase, family, kind, max(1 - levenshtein(phrase, entry)::DOUBLE / greatest(length(phrase), length(entry))) AS score FROM cd GROUP BY 1, 2, 3),
sc AS (SELECT u.*, family, kind, score FROM utt u JOIN bst ON bst.phrase = u.phrase)"""


@query("c19_lexicon_score", "WITH " + UTT + " SELECT event_id, family, kind, round(score, 9) AS score FROM sc")
def _(spark, d):
    s = jn.lexicon_score(utterances(b.events(spark, d)), lx.matching_table(spark))
    return s.select("event_id", "family", "kind", R("score", 9).alias("score"))


WORDS = """ent AS (SELECT DISTINCT lang AS family, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS entry FROM documents),
ask AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS phrase FROM benchmark),
ds AS (SELECT DISTINCT phrase FROM ask),
mt AS (SELECT phrase, family, entry, 1 - levenshtein(phrase, entry)::DOUBLE / greatest(length(phrase), length(entry)) AS score FROM ds JOIN ent
  ON length(entry) >= 0.75 * length(phrase) AND length(phrase) >= 0.75 * length(entry)),
bm AS (SELECT phrase, family, min(struct_pack(less := -score, entry := entry)) AS x FROM mt WHERE score >= 0.75 GROUP BY 1, 2)"""


@query("c19_lexicon_lookup", "WITH " + WORDS + " SELECT item_id, ask.phrase, family, x.entry AS entry, round(-x.less, 9) AS score FROM ask JOIN bm ON bm.phrase = ask.phrase")
def _(spark, d):
    """Words of the benchmark looked up in the lexicon of all longer words of the documents, by language."""
    words = lambda t, *cols: load(spark, d, t).select(*cols, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"))).alias("w"))
    lex = words("documents", F.col("lang").alias("family")).distinct().select("family", F.lit("active").alias("kind"), F.col("w").alias("entry"))
    ask = words("benchmark", "item_id").distinct().withColumnRenamed("w", "phrase")
    out = lk.lexicon_lookup(ask, materialise(lex, "lexicon"), floor=0.75)
    return out.select("item_id", "phrase", "family", "entry", R("score", 9).alias("score"))


FAM = "[" + ", ".join(f"'{f}'" for f in lx.FAMILIES) + "]"


def inventory(spark, d):
    """Devices at home: each customer owns two families, one room each."""
    c = load(spark, d, "customer")
    fam = F.array(*map(F.lit, lx.FAMILIES))
    room = F.array(*map(F.lit, lx.ROOMS))
    at = lambda arr, n, s: F.element_at(arr, (F.pmod(F.col("c_custkey") * s + s, F.lit(n)) + 1).cast("int"))
    rows = F.explode(F.array(*[F.struct(at(fam, 7, s).alias("family"), at(room, 3, s).alias("room")) for s in (1, 2)]))
    return c.select(F.col("c_custkey").alias("home"), rows.alias("i")).select("home", "i.family", "i.room")


INV = f"""inv AS (SELECT c_custkey AS home, {FAM}[CAST((c_custkey * s + s) % 7 + 1 AS INTEGER)] AS family, ['living room', 'kitchen', 'bedroom'][CAST((c_custkey * s + s) % 3 + 1 AS INTEGER)] AS room FROM customer, (VALUES (1), (2)) k(s))"""
LEX0 = "lex0 AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{e}')" for f in lx.FAMILIES for e in lx.LEXICON[f]) + ") v(family, entry))"


@query("c20_deploy_lexicon", "WITH " + INV + ", " + LEX0 + """, hm AS (SELECT DISTINCT home, family FROM inv)
SELECT DISTINCT home, hm.family AS device, entry, 'active' AS kind FROM hm JOIN lex0 ON lex0.family = hm.family
UNION SELECT a.home, a.family, entry, 'defensive' FROM hm a JOIN hm b ON b.home = a.home AND b.family <> a.family JOIN lex0 ON lex0.family = b.family""")
def _(spark, d):
    return jn.deploy_lexicon(lx.lexicon_table(spark), inventory(spark, d))


TH = "0.2 + 0.02 * length(phrase) + 0.3 * conf + 0.05 * coalesce(1 / nullif(snr, 0), 0) + 0.1 * CAST(event_type = 'error' AS INTEGER)"
DEC = UTT + f""", bs AS (SELECT event_id, home, room, family, phrase, {TH} AS theta, coalesce(max(CASE WHEN kind = 'active' THEN score END), 0) AS sa, coalesce(max(CASE WHEN kind = 'defensive' THEN score END), 0) AS sd FROM sc GROUP BY ALL),
dec AS (SELECT *, CASE WHEN sa >= theta THEN 'execute' WHEN sd - sa >= 0.1 AND sd >= 0.6 THEN 'reject' WHEN abs(sd - sa) < 0.1 THEN 'confirm' ELSE 'none' END AS decision FROM bs)"""


def decided(u, spark):
    th = theta(F.length("phrase"), "conf", "snr", (F.col("event_type") == "error").cast("int"), delta=0.05)
    scored = jn.lexicon_pairs(u.withColumn("theta", R(th, 9)), lx.matching_table(spark))
    best = scored.select("event_id", "home", "room", "family", "phrase", "theta", "s_act", "s_def")
    return dc.decide(best, F.col("theta"), F.lit(0.6), 0.1)


@query("n07_decide", "WITH " + DEC.replace(f"{TH} AS theta", f"round({TH}, 9) AS theta") + " SELECT event_id, family, round(sa, 9) AS s_act, round(sd, 9) AS s_def, theta, decision FROM dec")
def _(spark, d):
    out = decided(utterances(b.events(spark, d)), spark)
    return out.select("event_id", "family", R("s_act", 9).alias("s_act"), R("s_def", 9).alias("s_def"), "theta", "decision")


@query("n08_route", "WITH " + DEC.replace(f"{TH} AS theta", f"round({TH}, 9) AS theta") + ", " + INV + """, rm AS (SELECT home, family, list(DISTINCT room) AS rooms FROM inv GROUP BY 1, 2)
SELECT event_id, dec.family, decision, CASE WHEN decision <> 'execute' THEN NULL WHEN list_contains(rooms, room) THEN 'local' WHEN rooms IS NOT NULL THEN 'hub' END AS target
FROM dec LEFT JOIN rm ON rm.home = dec.home AND rm.family = dec.family""")
def _(spark, d):
    out = dc.route(decided(utterances(b.events(spark, d)), spark), inventory(spark, d))
    return out.select("event_id", "family", "decision", "target")


@query("n09_dedupe_late", "SELECT event_id, user_id AS station, value FROM events")
def _(spark, d):
    s = stream(spark, d)
    return replay(st.dedupe_late(s.unionByName(s), ["event_id"], "ts", "1 hour")).select("event_id", "station", "value")


@query("n10_log_sink", "WITH " + DEC.replace(f"{TH} AS theta", f"round({TH}, 9) AS theta") + """, r AS (SELECT event_id, family, decision, round(sa, 9) AS s_act, row_number() OVER (PARTITION BY event_id ORDER BY round(sa, 9) DESC, family) AS rank FROM dec)
SELECT event_id, family, decision, s_act, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""")
def _(spark, d):
    def step(batch):
        top = decided(utterances(batch), spark).withColumn("s_act", R("s_act", 9))
        return rs.top_candidates(top.select("event_id", "family", "decision", "s_act"), ["event_id"], "s_act", 2, "family")

    return st.log_sink(stream(spark, d), step)


@query("n11_trigger", """WITH u AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'),
j AS (SELECT u.event_id, u.user_id AS station, CASE WHEN u.ts - s.ts <= INTERVAL 1 DAY THEN s.event_id END AS trg_event_id FROM u ASOF LEFT JOIN s ON u.user_id = s.user_id AND u.ts >= s.ts)
SELECT event_id, station, trg_event_id, CASE WHEN trg_event_id IS NULL THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS theta FROM j""")
def _(spark, d):
    e = b.events(spark, d)
    u = e.where("event_type = 'view'").select("event_id", "station", "us", F.lit(0.6).alias("theta"))
    out = dc.trigger(u, e.where("event_type = 'signup'"), ["station"], 86400e6, 0.1)
    return out.select("event_id", "station", "trg_event_id", R("theta").alias("theta"))


@query("n11_trigger_stream", """WITH u AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'),
j AS (SELECT u.event_id, u.user_id AS station, u.ts, CASE WHEN u.ts - s.ts <= INTERVAL 1 DAY THEN s.event_id END AS trg_event_id FROM u ASOF LEFT JOIN s ON u.user_id = s.user_id AND u.ts >= s.ts)
SELECT event_id, station, trg_event_id, CASE WHEN trg_event_id IS NULL THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS theta FROM j WHERE epoch_us(ts) <= """ + BEHIND.format("event_type = 'view'", "event_type = 'signup'", 1))
def _(spark, d):
    """The partner's trigger on streams; events come out one day behind the watermark, as far as a trigger reaches."""
    u, s = two_streams(spark, d, "event_type = 'view'", "event_type = 'signup'")
    out = sj.partner_trigger(u.select("event_id", "station", "ts", F.lit(0.6).alias("theta")), s.select("event_id", "station", "ts"), ["station"], "ts", "event_id", "1 DAY", "10 minutes", 0.1)
    return replay(out).select("event_id", "station", "trg_event_id", R("theta").alias("theta"))


@query("n12_profile_weight", """WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'guest' ELSE 'owner' END AS profile, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'other' ELSE 'en' END AS lang, 1.0::DOUBLE / (1 + turn) AS score FROM conversations)
SELECT conv_id, turn, round(score * coalesce(CASE WHEN profile = 'owner' AND lang = 'en' THEN 1.5 WHEN profile = 'owner' AND lang = 'other' THEN 0.8 END, 1.0), 6) AS score FROM c""")
def _(spark, d):
    c = load(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", "guest").otherwise("owner").alias("profile"),
        F.when(F.col("text").rlike(r"[^\x00-\x7F]"), "other").otherwise("en").alias("lang"), (1.0 / (1 + F.col("turn"))).alias("score"))
    prof = spark.createDataFrame([("owner", "en", 1.5), ("owner", "other", 0.8)], "profile string, lang string, weight double")
    return dc.profile_weight(c, prof).select("conv_id", "turn", R("score").alias("score"))
