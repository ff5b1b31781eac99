"""Queries on flux towers, in batch and through real streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from landflux.functions import amount
from landflux.plans.registry import query
from landflux.session import run_dir
from landflux.streaming import live, towers
from landflux.streaming.budget import budget_schema

_MEANS = "tower_id:i start:m end:m n:i total_flux:d mean_flux:r6"


@query(_MEANS.replace(" end:m", ""), 'SELECT * FROM half_hours')
def half_hour_means(t):
    return towers.half_hour_means(t.tower_reading)


@query(
    _MEANS.replace(" end:m", ""),
    """SELECT tower_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 6 HOUR AS start,
              count(*) AS n, sum(CAST(flux AS DECIMAL(18,4))) AS total_flux,
              CAST(sum(CAST(flux AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean_flux
       FROM readings, range(4) AS r(i) GROUP BY ALL""",
)
def sliding_day(t):
    return towers.sliding_day(t.tower_reading)


@query(
    "tower_id:i first_ts:m last_ts:m n:i total_flux:d",
    """SELECT tower_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n,
              sum(CAST(flux AS DECIMAL(18,4))) AS total_flux
       FROM (SELECT *, sum(is_new) OVER (PARTITION BY tower_id ORDER BY ts, reading_id) AS session
             FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY tower_id ORDER BY ts, reading_id)
                                       <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS is_new FROM readings))
       GROUP BY tower_id, session""",
)
def tower_sessions(t):
    return towers.tower_sessions(t.tower_reading, 6 * 3600)


@query(
    "reading_id:i tower_id:i ts:m flux:r6",
    "SELECT DISTINCT reading_id, tower_id, ts, flux FROM readings",
)
def unique_readings(t):
    """Every reading comes twice and is kept once."""
    return towers.unique_readings(t.tower_reading.unionByName(t.tower_reading))


@query(
    "reading_id:i tower_id:i unit_id:i zone:s flux:r6",
    """SELECT reading_id, tower_id, unit_id, zone, flux
       FROM readings LEFT JOIN land_unit ON tower_id = unit_id""",
)
def readings_with_site(t):
    return towers.with_site(t.tower_reading, t.site)


@query(
    "reading_id:i tower_id:i ts:m flux:r6",
    """SELECT reading_id, tower_id, ts, flux FROM readings r WHERE kind = 'view' AND EXISTS (
         SELECT 1 FROM readings a WHERE a.kind = 'error' AND a.tower_id = r.tower_id
         AND r.ts >= a.ts AND r.ts <= a.ts + INTERVAL 6 HOUR)""",
)
def readings_after_alert(t):
    views = t.tower_reading.filter("kind = 'view'")
    return towers.readings_after_alert(views, t.alert, 6)


@query(
    "tower_id:i day:t day_flux:d n:i budget:d n_so_far:i",
    """SELECT *, sum(day_flux) OVER w AS budget, sum(n) OVER w AS n_so_far FROM (
         SELECT tower_id, CAST(ts AS DATE) AS day, sum(CAST(flux AS DECIMAL(18,4))) AS day_flux, count(*) AS n
         FROM readings GROUP BY ALL) WINDOW w AS (PARTITION BY tower_id ORDER BY day)""",
)
def running_budget(t):
    return towers.running_budget(t.tower_reading)


@query(
    "reading_id:i tower_id:i flux:r6 median_flux:r4 mad:r4",
    """WITH m AS (SELECT *, CAST(ts AS DATE) AS day,
                    quantile_cont(flux, 0.5) OVER (PARTITION BY tower_id, CAST(ts AS DATE)) AS median_flux
                  FROM readings),
       d AS (SELECT *, quantile_cont(abs(flux - median_flux), 0.5) OVER (PARTITION BY tower_id, day) AS mad
             FROM m)
       SELECT * FROM d WHERE abs(flux - median_flux) <= 3 * mad + 1e-9""",
)
def despike(t):
    return towers.despike(t.tower_reading, 3.0)


@query(
    "tower_id:i day:t n:i n_filled:i total:d",
    """WITH grid AS (SELECT tower_id, CAST(d AS DATE) AS day, s AS slot
                     FROM (SELECT DISTINCT tower_id FROM readings),
                          (SELECT unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS d
                           FROM readings),
                          (SELECT unnest(range(48)) AS s)),
       m AS (SELECT tower_id, CAST(start AS DATE) AS day,
                    hour(start) * 2 + CAST(minute(start) >= 30 AS INTEGER) AS slot, mean_flux FROM half_hours),
       f AS (SELECT g.*, mean_flux, avg(mean_flux) OVER (PARTITION BY g.tower_id, g.slot ORDER BY g.day
                    RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY FOLLOWING) AS nearby
             FROM grid g LEFT JOIN m USING (tower_id, day, slot))
       SELECT tower_id, day, count(*) AS n, count(*) FILTER (WHERE mean_flux IS NULL) AS n_filled,
              sum(CAST(floor(coalesce(mean_flux, nearby) * 1e4 + 0.5) / 1e4 AS DECIMAL(18,4))) AS total
       FROM f GROUP BY tower_id, day""",
)
def gap_fill(t):
    """Daily sums of the filled half hours."""
    filled = towers.gap_fill(towers.half_hour_means(t.tower_reading))
    return filled.groupBy("tower_id", "day").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("filled"), 1)).alias("n_filled"),
        F.sum(amount(F.col("flux"))).alias("total"),
    )


@query("tower_id:i n:i a:r6 b:r6 q10:r6", "SELECT * FROM fit")
def respiration_fit(t):
    return towers.respiration_fit(t.tower_reading)


@query(
    "reading_id:i tower_id:i respiration:r4 uptake:r4",
    """SELECT reading_id, tower_id, exp(a + b * temp_c) AS respiration, exp(a + b * temp_c) - flux AS uptake
       FROM readings LEFT JOIN fit USING (tower_id)""",
)
def partition_nee(t):
    return towers.partition_nee(t.tower_reading, towers.respiration_fit(t.tower_reading))


@query(
    "tower_id:i start:m n:i total_flux:d",
    """SELECT * FROM half_hours
       WHERE "end" <= (SELECT max(ts) FROM readings) - INTERVAL 10 MINUTE""",
)
def streamed_half_hours(t):
    """The event files as a stream, through the sink: half hours closed by the watermark."""
    readings = towers.with_lateness(live.stream_readings(t.spark, t.stream_path("events")), "10 minutes")
    out = run_dir(t.spark, "half-hours")
    query = live.ledger_sink(towers.half_hour_means(readings), out, run_dir(t.spark, "progress"))
    query.awaitTermination()
    return t.spark.read.schema(
        "tower_id bigint, start timestamp, n bigint, total_flux decimal(38,4)"
    ).parquet(out)


@query(
    "tower_id:i n:i budget:r4",
    """SELECT tower_id, count(*) AS n, sum(CAST(flux AS DECIMAL(18,4))) AS budget
       FROM readings GROUP BY tower_id""",
)
def streamed_budget(t):
    """Running budgets kept in state; the last of every tower."""
    readings = live.stream_readings(t.spark, t.stream_path("events"))
    out, progress = run_dir(t.spark, "budget"), run_dir(t.spark, "progress")
    query = live.update_sink(live.running_budget_stream(readings), out, progress)
    query.awaitTermination()
    updates = t.spark.read.schema(live.BUDGET_UPDATE).parquet(out)
    return live.latest_budgets(updates)


@query(
    "n_late:i n_kept:i",
    """WITH made AS (SELECT reading_id, ts, reading_id % 7 = 0 AND ts < last_ts - INTERVAL 1 HOUR AS late
                     FROM readings, (SELECT max(ts) AS last_ts FROM readings))
       SELECT count(*) FILTER (WHERE late) AS n_late, count(*) FILTER (WHERE NOT late) AS n_kept FROM made""",
)
def late_readings(t):
    """Every seventh reading is held back until all others are through, and so comes too late."""
    events = t.stored("events")
    last = events.agg(F.max("ts")).scalar()
    late = (F.col("event_id") % 7 == 0) & (F.col("ts") < last - F.expr("INTERVAL 1 HOUR"))
    marked = events.withColumn("late", F.coalesce(late, F.lit(False)))
    parts = [marked.filter(part).drop("late") for part in ("not late", "late")]
    source, out, progress = (run_dir(t.spark, name) for name in ("late-source", "late", "progress"))
    counter = live.LateReadings()

    def start():
        readings = towers.with_lateness(live.stream_readings(t.spark, source), "10 minutes")
        return live.ledger_sink(towers.unique_readings(readings), out, progress)

    t.spark.streams.addListener(counter)
    try:
        n_late = sum(counter.count(query) for query in live.run_in_parts(parts, source, start))
    finally:
        t.spark.streams.removeListener(counter)
    return t.spark.read.parquet(out).agg(F.lit(n_late).alias("n_late"), F.count("*").alias("n_kept"))


_DAYS = """SELECT *, sum(day_flux) OVER w AS budget, sum(n) OVER w AS n_so_far FROM (
             SELECT *, sum(CASE WHEN day - last_day > {idle} THEN 1 ELSE 0 END) OVER (PARTITION BY tower_id ORDER BY day) AS stretch
             FROM (SELECT *, lag(day) OVER (PARTITION BY tower_id ORDER BY day) AS last_day FROM (
               SELECT tower_id, CAST(ts AS DATE) AS day, sum(CAST(flux AS DECIMAL(18,4))) AS day_flux, count(*) AS n
               FROM readings GROUP BY ALL)))
           WINDOW w AS (PARTITION BY tower_id, stretch ORDER BY day)"""


@query("tower_id:i day:t day_flux:d n:i budget:d n_so_far:i", _DAYS.format(idle=3))
def budget_after_silence(t):
    """Budgets that start anew after more than three days without readings."""
    return towers.running_budget(t.tower_reading, idle_days=3)


@query(
    "tower_id:i day:t day_flux:d n:i budget:d n_so_far:i",
    f"""SELECT * FROM ({_DAYS.format(idle=3)})
        WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM readings) - INTERVAL 3 DAY""",
)
def streamed_budget_days(t):
    """The same from a stream: every fifth reading comes two days late, in three runs on one checkpoint."""
    events = t.stored("events")
    comes = F.col("ts") + F.when(F.col("event_id") % 5 == 0, F.expr("INTERVAL 2 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    first, last = events.agg(F.min("ts")).scalar(), events.agg(F.max("ts")).scalar()
    third = (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 3
    place = F.floor((F.unix_micros(comes.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / third)
    marked = events.withColumn("part", F.least(place, F.lit(2)))
    parts = [marked.filter(F.col("part") == k).drop("part") for k in range(3)]
    source, out, progress = (run_dir(t.spark, name) for name in ("budget-source", "budget-days", "progress"))

    def start():
        readings = towers.with_lateness(live.stream_readings(t.spark, source), "3 days")
        return live.ledger_sink(towers.running_budget(readings, idle_days=3), out, progress)

    live.run_in_parts(parts, source, start)
    return t.spark.read.schema(budget_schema()).parquet(out)
