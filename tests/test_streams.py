import random

import pandas as pd
from pyspark.sql import functions as F

from almanac.operators import joins as jn, timeseries as ts
from almanac.session import new_path
from almanac.sources.tables import stream_files
from almanac.streaming import alerts as al, decisions as dc, joins as sj, operators as st
from almanac.streaming.run import replay


def parts(spark, frames, schema):
    """One file per micro-batch, oldest first."""
    import time

    path = new_path(spark, "test-stream")
    for pdf in frames:
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return path


def test_alert_state_over_batches_equals_batch_twin(spark):
    rnd = random.Random(9)
    rows = [(s, t, int(rnd.random() < 0.5)) for s in range(6) for t in range(60)]
    pdf = pd.DataFrame(rows, columns=["station", "t", "flag"])
    schema = "station bigint, t int, flag int"
    path = parts(spark, [pdf[(pdf.t >= a) & (pdf.t < a + 15)] for a in range(0, 60, 15)], schema)
    got = replay(st.alert_state(stream_files(spark, path, schema, per_trigger=1), 2, 4))
    batch = ts.onsets(ts.min_duration(spark.createDataFrame(pdf, schema), "flag", ["station"], "t", 2), "flag", ["station"], "t", 4)
    want = {(r.station, r.t) for r in batch.where("onset = 1").collect()}
    assert {(r.station, r.onset_t) for r in got.collect()} == want and want


def test_state_is_carried_across_batches(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(5), i * 10, int(rnd.random() < 0.2), float(i)) for i in range(200)]
    pdf = pd.DataFrame(rows, columns=["id", "dev", "us", "is_state", "value"])
    schema = "id bigint, dev bigint, us bigint, is_state int, value double"
    path = parts(spark, [pdf.iloc[a:a + 50] for a in range(0, 200, 50)], schema)
    out = st.with_state(stream_files(spark, path, schema, per_trigger=1), F.col("is_state") == 1, ["dev"], "us", "id", "value", 400)
    full = spark.createDataFrame(pdf, schema)
    want = jn.asof_join(full.where("is_state = 0"), full.where("is_state = 1").select("dev", "us", "id", "value"), ["dev"], "us", "id", 400, prefix="state_")
    key = lambda df: {(r.id, r.state_value) for r in df.collect()}
    assert key(out) == key(want) and any(v is not None for _, v in key(out))


def test_decision_order(spark):
    rows = [(0.9, 0.95), (0.3, 0.8), (0.5, 0.55), (0.5, 0.2), (0.2, 0.45)]
    got = dc.decide(spark.createDataFrame(rows, "s_act double, s_def double"), F.lit(0.8), F.lit(0.6), 0.1).toPandas()["decision"].tolist()
    assert got == ["execute", "reject", "confirm", "none", "none"]


def test_routing(spark):
    d = spark.createDataFrame([(1, "tv", "kitchen", "execute"), (1, "tv", "bedroom", "execute"), (1, "oven", "kitchen", "execute"), (1, "tv", "kitchen", "reject")],
                              "home int, family string, room string, decision string")
    inv = spark.createDataFrame([(1, "tv", "kitchen")], "home int, family string, room string")
    got = sorted((r.family, r.room, r.decision, r.target or "") for r in dc.route(d, inv).collect())
    assert got == [("oven", "kitchen", "execute", ""), ("tv", "bedroom", "execute", "hub"), ("tv", "kitchen", "execute", "local"), ("tv", "kitchen", "reject", "")]


def test_lexicon_scores(spark):
    u = spark.createDataFrame([(1, "volume up"), (2, "volume u")], "id int, phrase string")
    lex = spark.createDataFrame([("tv", "active", "volume up"), ("oven", "defensive", "volume up")], "family string, kind string, entry string")
    got = {(r.id, r.family, r.kind): round(r.score, 4) for r in jn.lexicon_score(u, lex).collect()}
    assert got == {(1, "tv", "active"): 1.0, (1, "oven", "defensive"): 1.0, (2, "tv", "active"): 0.8889, (2, "oven", "defensive"): 0.8889}


def test_no_utterance_is_lost(spark):
    said = [(1, "mut"), (2, "paus"), (3, "xyzzy"), (4, None), (5, ""), (6, "MUTE")]
    u = spark.createDataFrame(said, "id int, phrase string")
    lex = spark.createDataFrame([("tv", "active", "mute"), ("tv", "active", "pause"), ("oven", "defensive", "stop")], "family string, kind string, entry string")
    got = {(r.id, r.family): r.score for r in jn.lexicon_score(u, lex, floor=0.5).collect()}
    assert got == {(1, "tv"): 0.75, (1, "oven"): 0.0, (2, "tv"): 0.8, (2, "oven"): 0.0, **{(i, f): 0.0 for i in (3, 4, 5) for f in ("tv", "oven")}, (6, "tv"): 1.0, (6, "oven"): 0.0}
    best = dc.best_scores(jn.lexicon_score(u, lex), ["id", "family"])
    assert best.select("id").distinct().count() == len(said)


def test_streams_resume_with_their_state(spark):
    """Two runs over a growing folder give what one run over all of it gives."""
    rnd = random.Random(8)
    rows = [(i, rnd.randrange(4), i * 10, int(rnd.random() < 0.2), float(i)) for i in range(120)]
    pdf = pd.DataFrame(rows, columns=["id", "dev", "us", "is_state", "value"])
    schema = "id bigint, dev bigint, us bigint, is_state int, value double"
    folder, store, out, ckpt = (new_path(spark, n) for n in ("grow", "store", "out", "ckpt"))
    for part in (pdf.iloc[:60], pdf.iloc[60:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        got = st.with_state(stream_files(spark, folder, schema), F.col("is_state") == 1, ["dev"], "us", "id", "value", 1e9, store, out, ckpt)
    full = spark.createDataFrame(pdf, schema)
    want = jn.asof_join(full.where("is_state = 0"), full.where("is_state = 1").select("dev", "us", "id", "value"), ["dev"], "us", "id", 1e9, prefix="state_")
    key = lambda df: sorted((r.id, r.state_value) for r in df.collect())
    assert str(key(got)) == str(key(want))


def test_alert_state_resumes(spark):
    flags = [0, 1, 1, 0, 0, 1, 1, 1, 0, 0, 0, 1, 1]
    schema = "station bigint, t int, flag int"
    folder, out, ckpt = (new_path(spark, n) for n in ("flags", "alerts", "ckpt"))
    for lo, hi in ((0, 6), (6, 13)):  # the second run starts inside a run of flags
        spark.createDataFrame([(1, t, flags[t]) for t in range(lo, hi)], schema).coalesce(1).write.mode("append").parquet(folder)
        got = replay(st.alert_state(stream_files(spark, folder, schema), 2, 4), out, ckpt)
    assert sorted(r.onset_t for r in got.collect()) == [1, 11]


def test_late_repeats_are_dropped(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:20:00")]
    path = new_path(spark, "late")
    df = spark.createDataFrame(rows, "id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(path)
    got = replay(st.dedupe_late(stream_files(spark, path, df.schema), ["id"], "ts", "1 hour"))
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_alerts_survive_any_order_within_the_lateness(spark):
    rnd = random.Random(3)
    flags = {s: [int(rnd.random() < 0.5) for _ in range(40)] for s in (1, 2)}
    rows = [(s, t, f) for s in flags for t, f in enumerate(flags[s])] + [(s, 100, 0) for s in flags]
    schema = "station bigint, t int, flag int"

    def onsets(per_file, shuffled):
        folder = new_path(spark, "flags")
        order = sorted(rows, key=lambda r: r[1] + (rnd.uniform(-4, 4) if shuffled else 0))
        for i in range(0, len(order), per_file):
            spark.createDataFrame(order[i : i + per_file], schema).coalesce(1).write.mode("append").parquet(folder)
        out = replay(st.alert_state(stream_files(spark, folder, schema, per_trigger=1), 2, 4, lateness=10))
        return sorted(map(tuple, out.collect()))

    want = []
    for s, f in flags.items():
        last, t = -100, 0
        while t < len(f):
            if f[t] and (t == 0 or not f[t - 1]) and t + 1 < len(f) and f[t + 1] and (last < 0 or t - last > 4):
                want.append((s, t))
                last = t
            t += 1
    assert onsets(82, False) == onsets(20, False) == onsets(20, True) == sorted(want)


def test_old_states_are_not_carried_on(spark):
    schema = "id bigint, dev bigint, us bigint, is_state int, value double"
    folder, store, out, ckpt = (new_path(spark, n) for n in ("ttl", "store", "out", "ckpt"))
    for part in ([(1, 1, 0, 1, 1.0), (2, 2, 90, 1, 2.0)], [(3, 2, 95, 0, 0.0), (4, 1, 200, 0, 0.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        got = st.with_state(stream_files(spark, folder, schema), F.col("is_state") == 1, ["dev"], "us", "id", "value", 50, store, out, ckpt)
    assert {r.id: r.state_value for r in got.collect()} == {3: 2.0, 4: None}
    assert spark.read.parquet(f"{store}/1").count() == 0 and spark.read.parquet(f"{store}/0").count() == 1


FLAGS = "station bigint, t int, flag int, ts timestamp"


def flag_rows(seed, n=40):
    rnd = random.Random(seed)
    day = lambda t: pd.Timestamp("2024-01-01") + pd.Timedelta(days=t)
    flags = {s: [int(rnd.random() < 0.5) for _ in range(n)] for s in (1, 2, 3)}
    rows = [(s, t, f, day(t)) for s in flags for t, f in enumerate(flags[s])] + [(9, 100, 0, day(100))]
    want = []
    for s, f in flags.items():
        last, t = -100, 0
        while t < n:
            if f[t] and (t == 0 or not f[t - 1]) and t + 1 < n and f[t + 1] and (last < 0 or t - last > 4):
                want.append((s, t))
                last = t
            t += 1
    return rows, sorted(want), rnd


def test_event_time_alerts_whatever_the_files(spark):
    """The same onsets, the last ones too, for 1, 3 and 16 files a trigger in shuffled order, and after a restart in the middle."""
    rows, want, rnd = flag_rows(5)
    order = sorted(rows, key=lambda r: r[1] + rnd.uniform(-4, 4))
    folder = parts(spark, [pd.DataFrame(order[i : i + 8], columns=["station", "t", "flag", "ts"]) for i in range(0, len(order), 8)], FLAGS)
    own = al.state_session(spark)
    for per in (1, 3, 16):
        alerts = al.onset_alerts(stream_files(own, folder, FLAGS, per_trigger=per), "ts", "10 days", 2, 4)
        assert sorted(map(tuple, replay(alerts, reader=spark).collect())) == want
    grow, out, ckpt = (new_path(spark, n) for n in ("grow", "alerts", "ckpt"))
    for part in (order[:60], order[60:]):
        spark.createDataFrame(pd.DataFrame(part, columns=["station", "t", "flag", "ts"]), FLAGS).coalesce(1).write.mode("append").parquet(grow)
        got = replay(al.onset_alerts(stream_files(own, grow, FLAGS), "ts", "10 days", 2, 4), out, ckpt, spark)
    assert sorted(map(tuple, got.collect())) == want


def test_silent_stations_are_forgotten_and_late_rows_left_out(spark):
    day = lambda t: pd.Timestamp("2024-01-01") + pd.Timedelta(days=t)
    batches = [[(1, 0, 1), (1, 1, 1), (2, 1, 0)], [(2, 30, 0)], [(2, 31, 0), (1, 2, 1)], [(1, 40, 1), (1, 41, 1), (2, 60, 0)], [(2, 61, 0)]]
    frames = [pd.DataFrame([(s, t, f, day(t)) for s, t, f in b], columns=["station", "t", "flag", "ts"]) for b in batches]
    folder = parts(spark, frames, FLAGS)
    own = al.state_session(spark)
    run = lambda keep: sorted(map(tuple, replay(al.onset_alerts(stream_files(own, folder, FLAGS, per_trigger=1), "ts", "1 day", 2, 50, keep), reader=spark).collect()))
    assert run(365) == [(1, 0)]  # the second run of flags lies within the refractory time
    assert run(10) == [(1, 0), (1, 40)]  # after ten silent days nothing is known of the first


def test_stream_join_equals_its_batch_twin_after_a_restart(spark):
    rnd = random.Random(11)
    at = sorted(rnd.sample(range(0, 86_400 * 10, 30), 400))
    rows = [(i, rnd.randrange(4), pd.Timestamp("2024-03-01") + pd.Timedelta(seconds=s), int(rnd.random() < 0.25), float(i)) for i, s in enumerate(at)]
    rows.append((999, 0, pd.Timestamp("2024-05-01"), 0, 0.0))
    rows.append((998, 0, pd.Timestamp("2024-05-01"), 1, 0.0))
    schema = "id bigint, dev bigint, ts timestamp, is_state int, value double"
    grow, out, ckpt = (new_path(spark, n) for n in ("pairs", "joined", "ckpt"))
    for part in (rows[:150], rows[150:300], rows[300:]):
        spark.createDataFrame(pd.DataFrame(part, columns=["id", "dev", "ts", "is_state", "value"]), schema).coalesce(1).write.mode("append").parquet(grow)
        s = lambda cond: stream_files(spark, grow, schema).where(cond)
        j = sj.latest_state(s("is_state = 0").select("id", "dev", "ts"), s("is_state = 1").select("id", "dev", "ts", "value"), ["dev"], "ts", "id", "6 HOURS", "1 hour", ["value"])
        got = replay(j, out, ckpt)
    full = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "dev", "ts", "is_state", "value"]), schema).withColumn("us", F.unix_micros("ts"))
    want = jn.asof_join(full.where("is_state = 0 AND id < 900"), full.where("is_state = 1").select("dev", "us", "id", "value"), ["dev"], "us", "id", 6 * 3600e6, prefix="state_")
    key = lambda df: sorted((r.id, r.state_id, r.state_value) for r in df.collect())
    assert str(key(got.where("id < 900"))) == str(key(want)) and sum(r.state_id is None for r in want.collect()) > 5


def test_partner_trigger_on_streams(spark):
    t = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(s)
    rows = [(1, 1, t("1h"), 0), (2, 1, t("2h"), 1), (3, 1, t("3h"), 0), (4, 1, t("30h"), 0), (5, 2, t("31h"), 0), (6, 9, t("90h"), 0), (7, 9, t("90h"), 1)]
    schema = "id bigint, dev bigint, ts timestamp, cycle int"
    folder = parts(spark, [pd.DataFrame(rows[:3], columns=["id", "dev", "ts", "cycle"]), pd.DataFrame(rows[3:], columns=["id", "dev", "ts", "cycle"])], schema)
    s = lambda cond: stream_files(spark, folder, schema, per_trigger=1).where(cond)
    u = s("cycle = 0").select("id", "dev", "ts", F.lit(0.6).alias("theta"))
    out = replay(sj.partner_trigger(u, s("cycle = 1").select("id", "dev", "ts"), ["dev"], "ts", "id", "24 HOURS", "10 minutes", 0.1))
    assert {r.id: (r.trg_id, round(r.theta, 6)) for r in out.collect()} == {1: (None, 0.6), 3: (2, 0.5), 4: (None, 0.6), 5: (None, 0.6)}
