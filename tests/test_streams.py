"""Streams give what batch gives, for windows the watermark has closed."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import SF
from pyspark.sql import functions as F

from landflux.sources import LandTables
from landflux.sources.schemas import READING
from landflux.sources.tables import alerts_from_events
from landflux.streaming import live, towers

SMALL = SF.format("0.001")
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The events in four files, in order of time."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = LandTables(spark, SMALL).stored("events")
    for part in range(4):
        cut = events.filter((F.col("event_id") >= part * 250) & (F.col("event_id") < (part + 1) * 250))
        cut.coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.fixture(scope="module")
def batch(spark):
    return LandTables(spark, SMALL).tower_reading


def stream(spark, files):
    return towers.with_lateness(live.stream_readings(spark, files, files_per_batch=1), "10 minutes")


def drain(spark, df, tmp_path, mode="append"):
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    run = live.ledger_sink if mode == "append" else live.update_sink
    query = run(df, out, progress)
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch_id"), query


def as_set(df, columns):
    return {tuple(r) for r in df.select(*columns).collect()}


@pytest.mark.parametrize("fn", [towers.half_hour_means, towers.sliding_day])
def test_windows(spark, files, batch, tmp_path, fn):
    columns = ["tower_id", "start", "end", "n", "total_flux", "mean_flux"]
    got, _ = drain(spark, fn(stream(spark, files)), tmp_path)
    last = batch.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    want = fn(batch).filter(F.col("end") <= F.lit(last))
    assert as_set(got, columns) == as_set(want, columns)
    assert got.count() == want.count() > 0


def test_sessions(spark, files, batch, tmp_path):
    gap = 6 * 3600
    columns = ["tower_id", "first_ts", "last_ts", "n", "total_flux"]
    got, _ = drain(spark, towers.tower_sessions(stream(spark, files), gap), tmp_path)
    last = batch.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10, seconds=gap)
    want = as_set(towers.tower_sessions(batch, gap).filter(F.col("last_ts") <= F.lit(last)), columns)
    assert as_set(got, columns) == want and len(want) > 0


def test_session_edges_equal_session_windows(spark):
    """Readings exactly one gap apart, and one second more, in both forms."""
    moments = [0, 600, 1200, 1801, 5000, 5600, 6200, 6800]
    df = spark.createDataFrame(
        [(i, 1, T0 + dt.timedelta(seconds=s), "view", 1.0, 1.0) for i, s in enumerate(moments)], READING
    )
    native = df.groupBy("tower_id", F.session_window("ts", "600 seconds")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")
    )
    columns = ["tower_id", "first_ts", "last_ts", "n"]
    assert as_set(towers.tower_sessions(df, 600), columns) == as_set(native, columns)


def test_site_join(spark, files, batch, tmp_path):
    site = LandTables(spark, SMALL).site
    columns = ["reading_id", "tower_id", "unit_id", "zone", "flux"]
    got, _ = drain(spark, towers.with_site(stream(spark, files), site), tmp_path)
    assert as_set(got, columns) == as_set(towers.with_site(batch, site), columns)
    assert got.count() == 1000


def test_readings_after_alert(spark, files, batch, tmp_path):
    source = spark.readStream.schema(LandTables(spark, SMALL).stored("events").schema)
    alerts = towers.with_lateness(
        alerts_from_events(source.option("maxFilesPerTrigger", 1).parquet(files)), "10 minutes", "alert_ts"
    )
    views = stream(spark, files).filter("kind = 'view'")
    got, _ = drain(spark, towers.readings_after_alert(views, alerts, 48), tmp_path)
    want = towers.readings_after_alert(batch.filter("kind = 'view'"), LandTables(spark, SMALL).alert, 48)
    assert as_set(got, ["reading_id", "flux"]) == as_set(want, ["reading_id", "flux"])
    assert got.count() == want.count() > 0


def test_running_budget(spark, files, batch, tmp_path):
    readings = live.stream_readings(spark, files, files_per_batch=1)
    drain(spark, live.running_budget_stream(readings), tmp_path, "update")
    updates = spark.read.parquet(str(tmp_path / "out"))
    got = {r.tower_id: (r.n, round(r.budget, 4)) for r in live.latest_budgets(updates).collect()}
    last = towers.running_budget(batch).groupBy("tower_id").agg(
        F.max("n_so_far").alias("n"), F.max_by("budget", "day").alias("budget")
    )
    assert got == {r.tower_id: (r.n, float(r.budget)) for r in last.collect()}
    assert updates.groupBy("tower_id").count().agg(F.max("count")).first()[0] > 1


def budget_rows(df):
    return {tuple(r) for r in df.select("tower_id", "day", "day_flux", "n", "budget", "n_so_far").collect()}


@pytest.mark.parametrize("idle_days", [None, 0, 2])
def test_budget_days(spark, files, batch, tmp_path, idle_days):
    """Closed days of four batches, each given out once, equal the batch rows."""
    got, _ = drain(spark, towers.running_budget(stream(spark, files), idle_days=idle_days), tmp_path)
    last = batch.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    want = towers.running_budget(batch, idle_days=idle_days).filter(F.date_add("day", 1).cast("timestamp") <= F.lit(last))
    assert budget_rows(got) == budget_rows(want) and got.count() == want.count() > 0
    if idle_days is not None:
        assert budget_rows(want) != budget_rows(towers.running_budget(batch).join(want.select("tower_id", "day"), ["tower_id", "day"]))


def test_budget_days_over_restarts_with_late_days(spark, tmp_path):
    """Days that come out of order, one too late, a null flux, and a tower that falls silent and comes back."""

    def reading(i, tower, day, flux):
        return (i, T0 + dt.timedelta(days=day, hours=i % 24), tower, "purchase", flux, '{"k": 5}')

    parts = [
        [reading(1, 1, 0, 2.0), reading(2, 1, 2, 4.0), reading(3, 2, 0, 1.5), reading(4, 2, 1, None)],
        [reading(5, 1, 1, 8.0), reading(6, 1, 4, 16.0), reading(7, 2, 2, 3.0), reading(8, 1, 0, 32.0)],
        [reading(9, 1, 3, 64.0), reading(10, 3, 20, 1.0)],
        [reading(11, 1, 19, 128.0), reading(12, 2, 5, 99.0), reading(13, 2, 30, 7.0)],
        [reading(14, 3, 60, 1.0)],
    ]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    frames = [spark.createDataFrame(part, schema) for part in parts]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def start():
        readings = towers.with_lateness(live.stream_readings(spark, source), "2 days")
        return live.ledger_sink(towers.running_budget(readings, idle_days=10), out, str(tmp_path / "progress"))

    live.run_in_parts(frames, source, start)
    got = sorted((r.tower_id, (r.day - T0.date()).days, r.n, r.budget, r.n_so_far) for r in spark.read.parquet(out).collect())
    # readings 12 (day 5) comes after day 20 has been seen, by more than two days: it is left out
    assert [tuple(float(x) if x is not None else None for x in r) for r in got] == [
        (1, 0, 2, 34, 2), (1, 1, 1, 42, 3), (1, 2, 1, 46, 4), (1, 3, 1, 110, 5), (1, 4, 1, 126, 6), (1, 19, 1, 128, 1),
        (2, 0, 1, 1.5, 1), (2, 1, 0, 1.5, 1), (2, 2, 1, 4.5, 2), (2, 30, 1, 7, 1),
        (3, 20, 1, 1, 1),
    ]
    kept = [r for k, part in enumerate(parts) for r in part if r[0] != 12]
    batch = towers.running_budget(live_readings(spark, kept, schema), idle_days=10).filter(F.col("day") < T0.date() + dt.timedelta(days=58))
    assert budget_rows(batch) == budget_rows(spark.read.parquet(out))


def live_readings(spark, rows, schema):
    from landflux.sources.tables import readings_from_events

    return readings_from_events(spark.createDataFrame(rows, schema))


def test_a_repeated_budget_batch_changes_nothing(spark, files, tmp_path):
    got, _ = drain(spark, towers.running_budget(stream(spark, files)), tmp_path)
    before = budget_rows(got)
    folder = tmp_path / "progress" / "commits"
    last = max(int(p.name) for p in folder.iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (folder / name).unlink(missing_ok=True)
    again, _ = drain(spark, towers.running_budget(stream(spark, files)), tmp_path)
    assert budget_rows(again) == before and again.count() == len(before)


@pytest.fixture
def untidy(spark, tmp_path):
    """Three files: in order; repeated and out of order; far too late."""
    def reading(i, minutes):
        return (i, T0 + dt.timedelta(minutes=minutes), 1, "purchase", float(i), '{"k": 5}')

    parts = [
        [reading(1, 0), reading(2, 40), reading(3, 100), reading(4, 101)],
        [reading(3, 100), reading(5, 95), reading(4, 101), reading(6, 140)],
        [reading(7, 1), reading(8, 2), reading(9, 150), reading(10, 400)],
    ]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    folder = tmp_path / "untidy"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        import time

        time.sleep(1.1)  # files are taken by age
    return str(folder)


def test_late_readings_are_counted(spark, untidy, tmp_path):
    counter = live.LateReadings()
    spark.streams.addListener(counter)
    got, query = drain(spark, towers.half_hour_means(towers.unique_readings(stream(spark, untidy))), tmp_path)
    assert counter.count(query) == 2  # 7 and 8, though they share one half hour
    spark.streams.removeListener(counter)
    first = got.filter(F.col("start") == F.lit(T0)).first()
    assert first.n == 1


def test_repeated_readings_are_kept_once(spark, untidy, tmp_path):
    got, _ = drain(spark, towers.unique_readings(stream(spark, untidy)), tmp_path)
    ids = [r.reading_id for r in got.collect()]
    assert sorted(ids) == [1, 2, 3, 4, 5, 6, 9, 10]


def test_sink_survives_a_repeated_batch(spark, files, tmp_path):
    df = towers.half_hour_means(stream(spark, files))
    got, _ = drain(spark, df, tmp_path)
    n = got.count()
    # lose the note that the last batch was done: it runs again on restart
    commits = sorted(int(p.name) for p in (tmp_path / "progress" / "commits").iterdir() if p.name.isdigit())
    folder = tmp_path / "progress" / "commits"
    for name in (f"{commits[-1]}", f".{commits[-1]}.crc"):
        (folder / name).unlink(missing_ok=True)
    again, _ = drain(spark, towers.half_hour_means(stream(spark, files)), tmp_path)
    assert again.count() == n and again.distinct().count() == n
