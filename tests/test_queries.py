"""Every registered query of the sensor engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}" if v else "0"
    return f"{float(v):.8g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in registry.ORACLE_SQL:
        found = db.sql(registry.ORACLE_SQL[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_flagship(spark, db):
    assert registry.flagship(spark, SF).count() > 0


def test_filter_and_columns_reach_the_scan(spark, db):
    from tidemark.plans.readings import sensor_readings

    plan = sensor_readings(spark, SF).where("sensor_type = 'temperature'").select("value")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string,value:double>" in plan and "PushedFilters: [" in plan


def same_as_sql(spark, folder, name, rows):
    """A query on events of our own, (seconds, event_type, value), against its SQL."""
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1)
    events = [(i, at + timedelta(seconds=s), i % 3, kind, v, '{"k":90}') for i, (s, kind, v) in enumerate(rows)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"file://{folder}/events.parquet")
    df, c = registry.QUERIES[name](spark, f"file://{folder}"), duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    found = c.sql(registry.ORACLE_SQL[name])
    at = [found.columns.index(x) for x in df.columns]
    got = sorted(tuple(map(plain, r)) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    return got


def test_cross_validation_at_one_time_and_at_full_humidity(spark, tmp_path):
    # At 100 % the dew point's sum is rounded as in the SQL (4.74 is -15.26 degrees); what has the same time is no pair.
    rows = [(0, "view", 4.74), (1, "click", 194.01), (300, "view", 60.0), (300, "click", 50.0), (400, "click", 20.0), (400, "view", 70.0), (1200, "view", 30.0)]
    assert len(same_as_sql(spark, tmp_path, "cross_validation_asof", rows)) == 5


def test_ambient_temperature_of_the_same_time(spark, tmp_path):
    # At 300 s the temperature of 70 degrees has the smaller seq, but not an earlier time.
    rows = [(0, "view", 30.0), (300, "view", 90.0), (300, "click", 90.0), (400, "click", 20.0), (1000, "view", 25.0), (1000, "click", 40.0)]
    got = same_as_sql(spark, tmp_path, "validate_humidity_ambient", rows)
    assert len(got) == 3
