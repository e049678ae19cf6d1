"""Operators whose state runs on, against plain Python; models; parsers; sinks; streams against batches."""

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import physics
from tidemark.operators import aggregate, flow, forest, fusion, schema, stages, validators
from tidemark.sources import connectors, files
from tidemark.streaming import stateful

READING = "sensor_id string, sensor_type string, value double, ts_ms long, quality double, seq long"


@pytest.fixture(scope="module")
def readings(spark):
    rng, rows, ts = random.Random(2), [], 1_700_000_000_000
    for i in range(400):
        ts += rng.choice([0, 50, 400, 3000])
        value = rng.choice([rng.gauss(20, 5), rng.gauss(20, 5), 500.0, float("nan")]) if i % 40 == 0 else rng.gauss(20, 5)
        rows.append((f"s{rng.randrange(4)}", rng.choice(["temperature", "humidity"]), value, ts, rng.random(), i))
    return spark.createDataFrame(rows, READING).cache()


def ordered(df):
    return sorted(df.collect(), key=lambda r: (r.ts_ms, r.seq))


# V1-V12
def test_validation_order_and_bounds(spark):
    rows = [(-80.0, 1.0), (125.0, 1.0), (125.1, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (None, 1.0), (20.0, 0.49), (20.0, 0.5), (-300.0, 0.0)]
    df = spark.createDataFrame([(f"s{i}", "temperature", v, 0, q, i) for i, (v, q) in enumerate(rows)], READING)
    got = [r.status for r in validators.validate(df, validators.TEMPERATURE).orderBy("seq").collect()]
    assert got == ["Valid", "Valid", "OutOfRange", "InvalidValue", "InvalidValue", "InvalidValue", "SensorQualityBad", "Valid", "OutOfRange"]


def test_rate_needs_time_to_advance(spark):
    rows = [(20.0, 1000), (30.0, 2000), (41.0, 3000), (41.0, 3000), (90.0, 3000)]
    df = spark.createDataFrame([("s", "temperature", v, t, 1.0, i) for i, (v, t) in enumerate(rows)], READING)
    got = [r.status for r in validators.validate(df, validators.TEMPERATURE).orderBy("seq").collect()]
    assert got == ["Valid", "Valid", "RateExceeded", "Valid", "Valid"]
    assert {r.status for r in validators.validate(df, validators.TEMPERATURE, history=False).collect()} == {"Valid"}


def test_limits():
    x = validators.temperature_limits(50, -400, -3)
    assert (x.low, x.high, x.max_rate) == (-273.15, 50, 3) and x.max_change(500) == 1.5
    y = validators.pressure_at_altitude(1000)
    assert (y.low, y.high) == (730, 970)


# F1-F3
def test_tables(spark):
    df = spark.createDataFrame([(20.0, 50.0, 0.0), (0.0, 100.0, 1000.0), (-40.0, 0.0, 50.0), (15.0, 75.0, 9999.0)], "t double, rh double, h double")
    got = [tuple(r) for r in df.select(physics.dew_point_table(F.col("t"), F.col("rh")), physics.altitude_adjustment(F.col("h"))).collect()]
    assert got == [(13.0, 0.0), (0.0, -120.0), (-78.0, -6.0), (12.5, -524.0)]


# G3
def test_cross_validation(spark, readings):
    got = {(r.seq, r.primary_id, r.secondary_id) for r in readings.transform(stages.cross_validate("temperature", "humidity", 5000)).collect()}
    last, expected = {}, set()
    for r in ordered(readings):
        other = last.get("humidity" if r.sensor_type == "temperature" else "temperature")
        if other and r.ts_ms - other.ts_ms <= 5000:
            expected.add((r.seq, r.sensor_id, other.sensor_id) if r.sensor_type == "temperature" else (r.seq, other.sensor_id, r.sensor_id))
        last[r.sensor_type] = r
    assert got == expected


# A1, A6, A7
@pytest.mark.parametrize(("most", "lossy"), [(None, False), (None, True), (5, False), (5, True)])
def test_anchored_windows(spark, readings, most, lossy):
    got = sorted((r.sensor_id, r.sensor_type, r.base_ts_ms, r["count"]) for r in aggregate.anchored(readings.where("not isnan(value)"), 4000, "mean", most, lossy).collect())
    expected, state = [], {}
    for r in ordered(readings.where("not isnan(value)")):
        key = (r.sensor_id, r.sensor_type)
        if key not in state:
            state[key] = [r.ts_ms, 0]
        s = state[key]
        if most and s[1] == most:
            expected.append((*key, *s))
            state[key] = [r.ts_ms, 1]
        elif r.ts_ms - s[0] >= 4000:
            if s[1]:
                expected.append((*key, *s))
            state[key] = [r.ts_ms, 0 if lossy else 1]
        else:
            s[1] += 1
    if not lossy:
        expected += [(*k, *s) for k, s in state.items() if s[1]]
    assert got == sorted(expected)


# T1
@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 500), max_size=60), st.floats(1, 20), st.floats(1, 10))
def test_token_bucket_never_admits_more_than_its_rate(gaps, rate, burst):
    times = np.cumsum(gaps).tolist()
    admitted = [t for t, ok in zip(times, flow.admissions(times, rate, burst), strict=True) if ok]
    for i in range(len(admitted)):
        for j in range(i, len(admitted)):
            assert j - i + 1 <= burst + (admitted[j] - admitted[i]) * rate / 1000 + 1e-6


# T4, T5
def test_merges_do_not_depend_on_the_order_of_rows(spark, readings):
    a, b = readings.where("sensor_type = 'humidity'"), readings.where("sensor_type = 'temperature'")
    for merge in (flow.merge_by_time, flow.merge_round_robin):
        one = [(r.seq, r.position) for r in merge(a, b).orderBy("position").collect()]
        two = [(r.seq, r.position) for r in merge(a.orderBy(F.rand(1)), b.orderBy(F.rand(2))).orderBy("position").collect()]
        assert one == two and [p for _, p in one] == list(range(400))


# U2-U7, U16, U17
def test_kalman_filters():
    rng = np.random.default_rng(0)
    f = fusion.KalmanFilter(np.eye(1), np.ones((2, 1)), np.eye(1) * 0.1, np.eye(2) * 0.5, np.zeros(1), np.eye(1))
    for i in range(100):
        f.predict()
        x = f.update(25 + rng.uniform(-0.5, 0.5, 2))
        assert i < 50 or abs(x - 25) < 0.5
    assert abs(f.confidence() - 0.88) < 0.02 and f.well_conditioned()
    g = fusion.KalmanFilter.of_size(1, 1, q=0.001, r=1e-4)
    for _ in range(10):
        g.predict()
        g.update(np.array([1.0]))
    assert g.converged()
    v = fusion.KalmanFilter.constant_velocity(0.1, 0.1, 0.1)
    for i in range(20):
        v.predict()
        v.update(np.array([i * 0.1 + 0.05]))
    assert abs(v.x[1] - 1.0) < 0.5
    before = f.x.copy()
    f.update(np.array([np.nan, np.nan]))
    assert (f.x == before).all()


@pytest.mark.parametrize("linear", [False, True])
def test_extended_models_stay_finite(linear):
    for model, z in ((fusion.temperature_model(), [22.0]), (fusion.pressure_altitude_model(), [1000.0]), (fusion.humidity_model(), [55.0]), (fusion.environmental_model(), [21.0, 45.0, 1005.0])):
        model.linear = linear
        for _ in range(30):
            x = model.step(np.array(z))
        assert np.isfinite(x).all() and np.allclose(model.p, model.p.T)
        assert abs((model.h @ x)[0] - z[0]) < 2


def test_scalar_filter_equals_the_matrix_form(spark, readings):
    clean = readings.where("not isnan(value)")
    got = {(r.sensor_id, r.sensor_type): (r.estimate, r.variance) for r in fusion.kalman_scalar(clean, 0.01, 0.04).collect()}
    filters = {}
    for r in ordered(clean):
        f = filters.setdefault((r.sensor_id, r.sensor_type), fusion.KalmanFilter.of_size(1, 1, 0.01, 0.04))
        f.predict()
        f.update(np.array([r.value]))
    assert got.keys() == filters.keys()
    assert all(np.allclose(got[k], (f.x[0], f.p[0, 0])) for k, f in filters.items())


def test_filters_run_over_keys(spark):
    rng = random.Random(61)
    rows = [(rng.choice(["a", "b", None]), t, t, rng.choice([None, rng.gauss(20, 2)]), rng.choice([None, rng.gauss(50, 5)])) for t in range(0, 30_000, 100)]
    df = spark.createDataFrame(rows, "sensor_id string, ts_ms long, seq long, t double, h double").repartition(5)
    models = (lambda: fusion.KalmanFilter.of_size(2, 2), lambda: fusion.environmental_model())
    for make, columns in zip(models, (("t", "h"), ("t", "h", "p")), strict=True):
        data = df.withColumn("p", F.lit(1000.0)) if "p" in columns else df
        got = {r.seq: r for r in fusion.filtered(data, make, columns, ("sensor_id",)).collect()}
        assert len(got) == len(rows)
        for key in ("a", "b", None):
            model, last = make(), None
            for _, ts, seq, *z in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
                seen = np.array([np.nan if v is None else v for v in z] + [1000.0] * ("p" in columns))
                dt = 0.1 if last is None else (ts - last) / 1000
                last = ts
                if isinstance(model, fusion.KalmanFilter):
                    model.predict(dt)
                    model.update(seen)
                else:
                    model.step(seen, dt)
                assert np.allclose(got[seq].state, model.x) and np.allclose(got[seq].variances, np.diag(model.p)) and got[seq].updates == model.n
    assert fusion.filtered(df.limit(0), models[0], ("t", "h"), ("sensor_id",)).count() == 0
    assert fusion.temperature_fusion().r[0, 0] == pytest.approx(0.01) and fusion.weighted_fusion("g", ("a",)).method == "weighted"


def test_validators_of_ones_own(spark, readings):
    class Even:
        sensor_type = "humidity"

        def status(self):
            return F.when(F.floor("value") % 2 == 0, "Valid").otherwise("OutOfRange")

    some = readings.where("not isnan(value)")
    got = validators.validate_with(some, [Even(), validators.DEFAULTS["temperature"]]).collect()
    same = {r.seq: r.status for r in validators.validate_all(some).collect()}
    for r in got:
        assert r.status == (same[r.seq] if r.sensor_type == "temperature" else "Valid" if math.floor(r.value) % 2 == 0 else "OutOfRange")


# U8, U10, U11
def test_array_fusion(spark):
    df = spark.createDataFrame([([25.0, 25.2, 24.8], 10), ([25.0, 25.2, None], 10), ([None, None, 1.0], 10), ([25.0, 25.1, 24.9], 1)], "v array<double>, n int")
    w = F.array(*[F.lit(1 / s**2) for s in (0.1, 0.2, 0.15)])
    got = [r[0] for r in df.select(fusion.weighted(F.col("v"), w, F.col("n"))["estimate"]).collect()]
    assert np.allclose(got[:2], [24.977, 25.04], atol=0.001) and got[2] == 1.0
    votes = df.select(fusion.consensus(F.col("v"), F.col("n"))["votes"], fusion.consensus(F.col("v"), F.col("n"))["estimate"]).collect()
    assert [r[0] for r in votes] == [3, 2, 1, 3] and votes[2][1] is None


GROUPS = [fusion.Group("w", ("s0", "s1"), weights={"s0": 3.0}), fusion.Group("c", ("s0", "s1", "s2", "s3"), "consensus", interval_ms=2000), fusion.Group("k", ("s2", "s3"), "kalman"), fusion.Group("a", ("s1", "s2"), "average", min_sensors=1)]


def test_fusion_gate(spark, readings):
    got = sorted((r.group_name, r.seq, round(r.estimate, 9), round(r.confidence, 9)) for r in fusion.fuse(readings, GROUPS).collect())
    fusers, expected = [fusion.Fuser(g) for g in GROUPS], []
    for r in ordered(readings):
        for f in fusers:
            if r.sensor_id in f.group.sensors and (found := f.add(r.sensor_id, r.ts_ms, r.value)):
                expected.append((f.group.name, r.seq, round(found[0], 9), round(found[1], 9)))
    assert got == sorted(expected) and expected


# M1-M8, F16-F18
def test_forest_finds_outliers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    model = forest.IsolationForest(trees=50).fit(x)
    scores = model.score(np.vstack([x[:50], [[8.0] * 4]]))
    assert scores[-1] > scores[:-1].max() and model.is_anomaly(np.array([[8.0] * 4]))[0]
    assert (forest.IsolationForest(trees=50).fit(x).score(x) == model.score(x)).all()
    assert forest.IsolationForest().score(x[:2]).tolist() == [0.5, 0.5]
    model.partial_fit(x, 0.2)
    assert model.stats()["trees"] == 50 and forest.Lcg(42).next() == (42 * 1664525 + 1013904223) % 2**32
    assert forest.path_length(1) == 0 and forest.path_length(3) == pytest.approx(3 - 4 / 3)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(300, None, 0.0, 0.0, 0.0)], "id int, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    got = forest.score_forest(df, forest.fit_forest(df, names, ["id"]), names).orderBy("id").collect()
    assert got[300].anomaly_score is None and all(0 < r.anomaly_score < 1 for r in got[:300])


# C1-C10
def test_registry_and_schemas():
    r = schema.Registry.with_defaults()
    assert r.versions("sensor_reading") == [1]
    for v in (2, 10):
        r.register(f"sensor_reading_v{v}", schema.SENSOR_READING)
    assert r.get("sensor_reading") is schema.SENSOR_READING and r.versions("sensor_reading") == [1, 2, 10]
    assert r.compatible("sensor_reading", 1, 10)
    with pytest.raises(ValueError):
        r.register("alert_v1", schema.ALERT)
    marked = schema.embed(schema.SENSOR_READING, "value", {"absolute": [-80, 125]})
    assert schema.extract(marked, "value") == {"absolute": [-80, 125]} and schema.extract(marked, "unit") is None
    avro = '{"type": "record", "name": "r", "fields": [{"name": "a", "type": ["null", "int"]}, {"name": "b", "type": {"type": "array", "items": "string"}}, {"name": "c", "type": {"type": "map", "values": "double"}}]}'
    assert schema.from_avro_json(avro).simpleString() == "struct<a:int,b:array<string>,c:map<string,double>>"
    assert schema.limits_from("humidity_percent").high == 100 and schema.limits_from("pressure_hpa") is validators.PRESSURE


# S1-S8
CSV = ["# comment", "", "1,temp_01,temperature,22.5,0.95\r", '2,"hum_01","HUMID",45.0,0.9', "3,p,press,1013.2", "4,t,temp,22.0,0.5 # trailing", "5,t,temp,22.0,7", "6,t,unknown,1,1", "7,t,temp,abc,1", "8", "x,t,temp,1,1", "9,t,temp,1,1,extra,more", "a" * 300]


def test_csv(spark):
    parsed = files.parse_csv(spark.createDataFrame([(x,) for x in CSV], "value string"))
    good = [tuple(r) for r in files.accepted(parsed).orderBy("ts_ms").collect()]
    assert good == [(1, "temp_01", "temperature", 22.5, 0.95), (2, "hum_01", "humidity", 45.0, 0.9), (3, "p", "pressure", 1013.2, 1.0), (4, "t", "temperature", 22.0, 0.5), (5, "t", "temperature", 22.0, 1.0), (9, "t", "temperature", 1.0, 1.0)]
    assert tuple(files.parse_stats(parsed).first()) == (6, 5, 11)
    assert {r.reject for r in files.rejected(parsed).collect()} == {"unknown sensor type", "bad value", "no sensor id", "bad timestamp", "line too long"}


def test_jsonl(spark):
    lines = ['{"timestamp": 1704067260, "sensor_id": "a", "type": "Temp", "value": 1.5, "confidence": 2}', '{"ts": 5, "id": "b", "sensor_type": "PRESSURE", "reading": 9, "quality": 0.25}', '{"ts": 6, "id": "c", "type": "humid", "value": 3}', "{broken", '{"ts": 7}']
    parsed = files.parse_jsonl(spark.createDataFrame([(x,) for x in lines], "value string"), ts_unit_ms=1000)
    good = [tuple(r) for r in files.accepted(parsed).orderBy("ts_ms").collect()]
    assert good == [(5000, "b", "pressure", 9.0, 0.25), (6000, "c", "humidity", 3.0, 1.0), (1704067260000, "a", "temperature", 1.5, 1.0)]
    assert files.rejected(parsed).count() == 2


def test_binary(spark, tmp_path):
    raw = files.write_binary([(1, 0, "temp", 22.5, 1.0), (2, 2, "é" * 7, 1000.0, 0.5), (3, 9, "x", 1.0, 1.0)])
    (tmp_path / "a.bin").write_bytes(raw + b"rest")
    parsed = files.read_binary(spark, f"file://{tmp_path}")
    assert [tuple(r) for r in files.accepted(parsed).orderBy("ts_ms").collect()] == [(1, "temp", "temperature", 22.5, 1.0), (2, "é" * 7, "pressure", 1000.0, 0.5)]
    assert sorted(r.reject for r in files.rejected(parsed).collect()) == ["truncated record", "unknown sensor type"]
    with pytest.raises(ValueError):
        files.write_binary([(1, 0, "x" * 16, 0.0, 0.0)])


# K1-K8, S10
def test_http_retries():
    codes, waits = [500, OSError("down"), 429, 200], []

    def transport(url, body):
        x = codes.pop(0)
        if isinstance(x, OSError):
            raise x
        return x

    stats = connectors.Stats()
    assert connectors.HttpSink(transport, "u", sleep=waits.append).post(b"abc", stats)
    assert waits == [0.1, 0.2, 0.4] and (stats.sent, stats.bytes) == (1, 3)
    assert not connectors.HttpSink(lambda u, b: 404, "u", sleep=waits.append).post(b"x", stats) and stats.failed == 1 and len(waits) == 3
    assert connectors.HttpSink(transport, "u", auth={"type": "bearer", "token": "t"}).headers() == {"Authorization": "Bearer t"}


def test_http_sends_its_credentials():
    seen = []
    sink = connectors.HttpSink(lambda url, body, headers: seen.append(headers) or 200, "u", auth={"type": "basic", "user": "a", "password": "b"})
    assert sink.post(b"x", connectors.Stats()) and seen == [{"Authorization": "Basic YTpi"}]
    key = connectors.HttpSink(lambda url, body, headers: seen.append(headers) or 200, "u", auth={"type": "api_key", "header": "X-Key", "key": "k"})
    assert key.post(b"x", connectors.Stats()) and seen[1] == {"X-Key": "k"}


def test_publisher_options_batches_and_reconnections():
    seen, now, up = [], [0.0], [True]

    def transport(topic, payload, options=None):
        if not up[0]:
            raise OSError("offline")
        seen.append((topic, payload, options))
        return 200

    p = connectors.Publisher(transport, qos=1, batch=3, clock=lambda: now[0])
    assert all(p.send("t", str(i).encode()) for i in range(2)) and not seen
    p.send("t", b"2")
    p.flush_batches(0)
    assert [m["payload"] for m in json.loads(seen[0][1])] == ["0", "1", "2"] and seen[0][2] == {"qos": 1, "retain": False}
    p.send("u", b"3")
    p.flush_batches(99)
    assert len(seen) == 1
    p.flush_batches(100)
    assert len(seen) == 2 and json.loads(seen[1][1])[0]["topic"] == "u"
    kept = connectors.Publisher(transport, retain=True, batch=3)
    up[0] = False
    assert not kept.send("r", b"x") and not kept.is_connected()
    up[0] = True
    assert kept.send("r", b"y") and kept.is_connected() and kept.stats.reconnections == 1 and seen[-1] == ("r", b"y", {"qos": 0, "retain": True})
    with pytest.raises(ValueError):
        connectors.Publisher(transport, qos=3)


def test_subscriptions(spark):
    topics = ["a/b", "a/b/c", "a", "b", "$sys/a", None, "a/x/c", "a.b"]
    df = spark.createDataFrame([(t,) for t in topics], "topic string")
    subs = connectors.Subscriptions()
    assert subs.delivered(df).count() == 0
    for f, expected in (("a/#", {"a/b", "a/b/c", "a", "a/x/c"}), ("a/+/c", {"a/b/c", "a/x/c"}), ("+", {"a", "b", "a.b"}), ("#", set(topics) - {None, "$sys/a"}), ("$sys/+", {"$sys/a"}), ("a.b", {"a.b"})):
        subs = connectors.Subscriptions()
        subs.subscribe(f)
        assert {r.topic for r in subs.delivered(df).collect()} == expected, f
        subs.unsubscribe(f)
        assert not subs.filters
    for bad in ("", "a/#/b", "a+/b"):
        with pytest.raises(ValueError):
            subs.subscribe(bad)


def test_coap_messages_come_back():
    for options in ([], [(11, b"a"), (12, b""), (300, b"x" * 300), (2000, b"y" * 20)]):
        for payload in (b"", b"p" * 70):
            m = connectors.coap_decode(connectors.coap_encode(1, 69, 77, b"tok", options, payload))
            assert (m.kind, m.code, m.message_id, m.token, m.options, m.payload) == (1, 69, 77, b"tok", options, payload)
    for bad in (b"", b"\x00\x01\x00\x00", b"\x49\x01\x00\x00", b"\x40\x01\x00\x00\xff", b"\x40\x01\x00\x00\xf1", b"\x40\x01\x00\x00\x15a"):
        with pytest.raises(ValueError):
            connectors.coap_decode(bad)

    def server(raw):
        m = connectors.coap_decode(raw)
        path = b"/".join(v for n, v in m.options if n == connectors.URI_PATH)
        return connectors.coap_encode(2, 69 if path == b"sensors/1" else 132, m.message_id, m.token, payload=b"22.5" if m.code == connectors.COAP_GET else m.payload)

    client = connectors.CoapClient(server)
    assert client.get("/sensors/1") == b"22.5" and client.post("sensors/1", b"set") == b"set" and client.next_id == 3
    with pytest.raises(OSError):
        client.get("nothing")


def test_lines_after_the_first(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("id file\nunits\n" + "".join(f"{i},{name},temp,{i}.5\n" for i in range(5)))
    got = files.accepted(files.read_csv(spark, str(tmp_path), skip_lines=2)).collect()
    assert sorted((r.sensor_id, r.ts_ms, r.value) for r in got) == sorted((n, i, i + 0.5) for n in "ab" for i in range(5))
    assert files.read_lines(spark, str(tmp_path), 6).count() == 2 and files.read_lines(spark, str(tmp_path), 9).count() == 0


def test_replay_in_parts(spark):
    replay = files.Replay(spark, [("a", "temperature", float(i), i, 1.0) for i in range(5)])
    assert [r.seq for r in replay.next(3).collect()] == [0, 1, 2] and replay.remaining == 2
    assert replay.next(3).count() == 2 and replay.exhausted
    with pytest.raises(EOFError):
        replay.next()
    replay.reset()
    assert replay.position == 0 and replay.next(1).first().value == 0.0


def test_positions_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "sensor_type string, ts_ms long, seq long").repartition(13)
    got = {r.seq: r.batch_no for r in flow.batch_by_count(df, 7).collect()}
    for kind in (None, "a", "b"):
        ordered = sorted((t, i) for k, t, i in rows if k == kind)
        assert [got[i] for _, i in ordered] == [n // 7 for n in range(len(ordered))]


def test_publisher_buffers_and_drops_the_oldest():
    up, got = [False], []

    def transport(topic, payload):
        if not up[0]:
            raise OSError("offline")
        got.append(payload)
        return 200

    p, stats = connectors.Publisher(transport, buffer=3), connectors.Stats()
    for i in range(5):
        assert not p.publish("t", bytes([i]), stats)
    up[0] = True
    assert p.publish("t", b"\x05", stats) and got == [b"\x03", b"\x04", b"\x05"] and stats.failed == 3


def test_send_and_coap(spark):
    df = spark.createDataFrame([("{}",), ("[]",)], "body string").coalesce(1)
    assert connectors.send(df, connectors.HttpSink(lambda u, b: 200, "u")).first().sent == 2
    assert connectors.coap_encode(0, 2, 0x1234, b"\x01", [(11, b"a"), (12, b"")], b"p") == b"\x41\x02\x12\x34\x01\xb1a\x10\xffp"


def polled(url):
    return [{"url": url, "n": i} for i in range(2)]


def test_polled_source(spark):
    spark.dataSource.register(connectors.PolledSource)
    got = spark.read.format("polled").option("url", "a,b").option("fetch", "tests.test_operators:polled").load()
    assert sorted(r.value for r in got.collect())[0] == '{"url": "a", "n": 0}' and got.count() == 4


# T8, T11: batches in three files, one file a trigger
@pytest.fixture(scope="module")
def stream(spark, readings, tmp_path_factory):
    path = tmp_path_factory.mktemp("stream")
    for i in range(3):
        part = readings.where(f"seq between {i * 134} and {i * 134 + 133}").coalesce(1)
        part.write.mode("append").parquet(f"file://{path}")
    return lambda: spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(f"file://{path}")


def test_validators_stream_like_a_batch(spark, readings, stream, tmp_path):
    got = {r.seq: r.status for r in stateful.run_once(stateful.validate_stream(stream()), "v", str(tmp_path)).collect()}
    assert got == {r.seq: r.status for r in validators.validate_all(readings).collect()}


def test_fusion_streams_like_a_batch(spark, readings, stream, tmp_path):
    key = lambda r: (r.group_name, r.seq, round(r.estimate, 9))
    got = sorted(map(key, stateful.run_once(stateful.fuse_stream(stream(), GROUPS), "f", str(tmp_path)).collect()))
    assert got == sorted(map(key, fusion.fuse(readings, GROUPS).collect()))


def test_windows_stream_like_a_batch(spark, readings, stream, tmp_path):
    got = stateful.run_once(stateful.tumbling_stream(stream(), 60_000, "1 hour"), "w", str(tmp_path), "complete").collect()
    expected = aggregate.tumbling(readings, 60_000).collect()
    key = lambda r: (r.sensor_type, r.base_ts_ms, r["count"], None if math.isnan(r.result_value) else round(r.result_value, 9))
    assert sorted(map(str, map(key, got))) == sorted(map(str, map(key, expected)))


def test_other_streams_run(spark, stream, tmp_path):
    assert stateful.run_once(stateful.ema_stream(stream()), "e", str(tmp_path / "e")).count() == 400
    assert stateful.run_once(stateful.deduplicated(stream(), ["sensor_id", "seq"]), "d", str(tmp_path / "d")).count() == 400
    assert stateful.run_once(stateful.session_stream(stream(), "10 seconds", "1 hour"), "s", str(tmp_path / "s"), "complete").count() > 0
    kept = [stateful.run_once(stream().transform(stages.keep(c)), name, str(tmp_path / name)).count() for name, c in (("p", F.col("quality") > 0.5), ("q", F.col("quality") <= 0.5))]
    assert sum(kept) == 400 and min(kept) > 0
