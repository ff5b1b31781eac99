"""Operators over tower readings.

Streams are expected with a watermark on ``ts`` (``with_lateness``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landflux.operators.prepare import latest_per_key
from landflux.operators.quantiles import value_counts, with_median

DIGITS = 4  # decimal places of a flux; fluxes of a finer scale need more
HALF_HOUR = 1800


def fixed_flux(digits: int = DIGITS) -> Column:
    """The flux as a decimal, so that sums do not depend on row order."""
    return F.col("flux").cast(f"decimal(28,{digits})")


def with_lateness(readings: DataFrame, delay: str = "10 minutes", column: str = "ts") -> DataFrame:
    """Set how late a reading may come; batch frames pass unchanged."""
    return readings.withWatermark(column, delay) if readings.isStreaming else readings


def _window_means(readings: DataFrame, window: Column, digits: int) -> DataFrame:
    total = F.sum(fixed_flux(digits))
    return (
        readings.groupBy("tower_id", window.alias("w"))
        .agg(F.count("flux").alias("n"), total.alias("total_flux"))
        .select(
            "tower_id",
            F.col("w.start").alias("start"),
            F.col("w.end").alias("end"),
            "n",
            "total_flux",
            (F.col("total_flux").cast("double") / F.col("n")).alias("mean_flux"),
        )
    )


def half_hour_means(readings: DataFrame, digits: int = DIGITS) -> DataFrame:
    return _window_means(readings, F.window("ts", "30 minutes"), digits)


def sliding_day(readings: DataFrame, digits: int = DIGITS) -> DataFrame:
    """A day's mean, every six hours."""
    return _window_means(readings, F.window("ts", "24 hours", "6 hours"), digits)


def tower_sessions(readings: DataFrame, gap_seconds: int, digits: int = DIGITS) -> DataFrame:
    """Periods of operation: readings no further apart than the gap.

    A stream uses Spark's session windows. In batch, readings in the same
    gap-wide slot belong together whatever lies between them, so slots are
    summed first; the window then grows with time and not with readings.
    """
    total = F.sum(fixed_flux(digits)).alias("total_flux")
    if readings.isStreaming:
        session = F.session_window("ts", f"{gap_seconds} seconds").alias("w")
        return (
            readings.groupBy("tower_id", session)
            .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), total)
            .select("tower_id", "first_ts", "last_ts", "n", "total_flux")
        )
    slot = F.floor(F.unix_micros("ts") / (gap_seconds * 1_000_000))
    slots = readings.groupBy("tower_id", slot.alias("slot")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), total
    )
    by_tower = Window.partitionBy("tower_id").orderBy("slot")
    apart = F.unix_micros("first_ts") - F.lag(F.unix_micros("last_ts")).over(by_tower)
    begins = F.coalesce(apart > gap_seconds * 1_000_000, F.lit(True))
    return (
        slots.withColumn("_new", begins.cast("int"))
        .withColumn("_session", F.sum("_new").over(by_tower))
        .groupBy("tower_id", "_session")
        .agg(
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.sum("n").alias("n"),
            F.sum("total_flux").alias("total_flux"),
        )
        .drop("_session")
    )


def unique_readings(readings: DataFrame) -> DataFrame:
    """One row per reading id: the earliest in batch, the first to come in a stream."""
    if readings.isStreaming:
        return readings.dropDuplicatesWithinWatermark(["reading_id"])
    return latest_per_key(
        readings,
        ["reading_id"],
        [F.col(c).asc() for c in ("ts", "tower_id", "flux", "kind", "temp_c") if c in readings.columns],
    )


def with_site(readings: DataFrame, site: DataFrame) -> DataFrame:
    """Add unit and zone; ``site`` is static and has one row per tower."""
    return readings.join(site, "tower_id", "left")


def readings_after_alert(readings: DataFrame, alerts: DataFrame, hours: int) -> DataFrame:
    """Readings at most ``hours`` after an alert of their tower, each once.

    In batch, time is cut into slots as long as the interval. An alert in the
    reading's own slot counts if the first one there is not after the reading;
    one in the slot before counts if the last one there is near enough. So two
    numbers per tower and slot decide, and no reading is set against all alerts.
    A stream joins on the slot too, which spreads a busy tower over its slots.
    """
    length = hours * 3_600_000_000
    micros = F.unix_micros("ts")
    placed = readings.withColumn("slot", F.floor(micros / length))
    if readings.isStreaming:
        first = F.floor(F.unix_micros("alert_ts") / length)
        listed = alerts.select(
            F.col("tower_id").alias("alert_tower"),
            "alert_ts",
            F.explode(F.array(first, first + 1)).alias("alert_slot"),
        )
        near = F.expr(
            "tower_id = alert_tower and slot = alert_slot and ts >= alert_ts "
            f"and ts <= alert_ts + interval {hours} hours"
        )
        return placed.join(listed, near, "left_semi").drop("slot")
    stamped = alerts.select("tower_id", F.unix_micros("alert_ts").alias("a"))
    own = stamped.select("tower_id", F.floor(F.col("a") / length).alias("slot"), F.col("a").alias("own"))
    before = stamped.select(
        "tower_id", (F.floor(F.col("a") / length) + 1).alias("slot"), F.col("a").alias("before")
    )
    slots = (
        own.unionByName(before, allowMissingColumns=True)
        .groupBy("tower_id", "slot")
        .agg(F.min("own").alias("_own"), F.max("before").alias("_before"))
    )
    hit = (F.col("_own") <= micros) | (F.col("_before") >= micros - length)
    return (
        placed.join(slots, ["tower_id", "slot"])
        .filter(F.coalesce(hit, F.lit(False)))
        .select(*readings.columns)
    )


def running_budget(readings: DataFrame, digits: int = DIGITS, idle_days: int | None = None) -> DataFrame:
    """Cumulative flux of each tower at the end of each day with readings.

    With ``idle_days``, a gap of more days without readings starts the budget
    anew. A stream gives every day once, after its end has passed the watermark.
    """
    if readings.isStreaming:
        from landflux.streaming.budget import budget_days

        return budget_days(readings, digits, idle_days)
    by_tower = Window.partitionBy("tower_id").orderBy("day")
    days = readings.groupBy("tower_id", F.to_date("ts").alias("day")).agg(
        F.sum(fixed_flux(digits)).alias("day_flux"), F.count("flux").alias("n")
    )
    stretch = F.lit(0)
    if idle_days is not None:
        gap = F.date_diff("day", F.lag("day").over(by_tower)) > idle_days
        days = days.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int"))
        stretch = F.sum("_new").over(by_tower)
    window = (
        Window.partitionBy("tower_id", "_stretch")
        .orderBy("day")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return days.withColumn("_stretch", stretch).select(
        "tower_id",
        "day",
        "day_flux",
        "n",
        F.sum("day_flux").over(window).alias("budget"),
        F.sum("n").over(window).alias("n_so_far"),
    )


def despike(readings: DataFrame, k: float, digits: int = DIGITS) -> DataFrame:
    """Readings no further than ``k`` median deviations from their tower-day's median.

    Both medians come from the tower-day's value counts, which stay few however
    many readings there are: fluxes within 500 with two decimals have 100,000
    values. A deviation is a value less the median, as often as the value, so
    one shuffle by tower-day serves both. Medians are exact to ``digits`` places.
    """
    scale = 10**digits
    keys = ["tower_id", "day"]
    dated = readings.withColumn("day", F.to_date("ts"))
    counts = value_counts(dated, keys, "flux", scale)
    middle = with_median(counts, keys, "v", "middle").withColumn("off", F.expr("abs(v - middle)"))
    limits = (
        with_median(middle, keys, "off", "spread")
        .groupBy(*keys)
        .agg(
            (F.max("middle") / scale).alias("median_flux"),
            (F.max("spread") / scale).alias("mad"),
        )
    )
    return (
        dated.join(limits, keys)
        .filter(F.abs(F.col("flux") - F.col("median_flux")) <= F.col("mad") * k + 1e-5 / scale)
        .select(*readings.columns, "median_flux", "mad")
    )


BLOCK = 64  # days whose half hours one row holds in gap_fill


def gap_fill(means: DataFrame, first_day: str | None = None, last_day: str | None = None, days: int = 7) -> DataFrame:
    """Every half hour of every tower; empty ones take the mean of that time of day nearby.

    ``means`` is ``half_hour_means``. Without days given, the range is that of
    the data. A half hour with nothing nearby keeps a null flux.

    Only what was measured is shuffled: a tower's half hours are gathered by
    blocks of ``BLOCK`` days, those within ``days`` of a block's ends in both
    blocks, and the empty ones are listed where their block lies. All rows of a
    tower stay in one task, so sums by tower and day need no further shuffle.
    """
    stamps = means.select(
        "tower_id",
        F.to_date("start").alias("day"),
        (F.floor(F.unix_seconds("start") / HALF_HOUR) % 48).cast("int").alias("slot"),
        "mean_flux",
    )
    given = [F.lit(d).cast("date") for d in (first_day, last_day)]
    ends = [F.coalesce(given[0], F.min("day")), F.coalesce(given[1], F.max("day"))]
    from_day, to_day = (stamps.agg(end).scalar() for end in ends)

    def with_range(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", from_day.alias("from_day"), to_day.alias("to_day")).filter("from_day <= to_day")
        return rows.withColumn("last", F.expr(f"datediff(to_day, from_day) div {BLOCK}"))

    at = "datediff(day, from_day)"
    # a null tower has no stamps of its own
    near = with_range(stamps.filter("tower_id is not null")).filter("day between from_day and to_day").selectExpr(
        "tower_id",
        f"explode(sequence(greatest({at} - {days}, 0) div {BLOCK}, least(({at} + {days}) div {BLOCK}, last))) as block",
        "named_struct('day', day, 'slot', slot, 'mean_flux', mean_flux) as stamp",
    )
    listed = with_range(stamps.select("tower_id").distinct()).selectExpr("tower_id", "explode(sequence(0L, last)) as block")
    blocks = (
        near.unionByName(listed, allowMissingColumns=True)
        .repartition("tower_id")
        .groupBy("tower_id", "block")
        .agg(F.array_sort(F.collect_list("stamp")).alias("stamps"))
    )
    slots = with_range(blocks).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(47))))
    slots = slots.withColumn("stamps", F.expr("filter(stamps, s -> s.slot = slot)"))
    begin = f"date_add(from_day, cast(block * {BLOCK} as int))"
    grid = slots.selectExpr(
        "tower_id", "slot", "stamps", f"explode(sequence({begin}, least(date_add({begin}, {BLOCK - 1}), to_day))) as day"
    )
    return (
        grid.selectExpr(
            "tower_id",
            "day",
            "slot",
            f"filter(stamps, s -> s.mean_flux is not null and abs(datediff(s.day, day)) <= {days}).mean_flux as near",
            "explode_outer(filter(stamps, s -> s.day = day).mean_flux) as mean_flux",
        )
        .withColumn("nearby", F.expr("try_divide(aggregate(near, 0D, (sum, flux) -> sum + flux), size(near))"))
        .select(
            "tower_id",
            "day",
            "slot",
            F.coalesce("mean_flux", "nearby").alias("flux"),
            F.col("mean_flux").isNull().alias("filled"),
        )
    )


def respiration_fit(readings: DataFrame) -> DataFrame:
    """Per tower, ln(flux) = a + b * temperature over positive readings; Q10 = e^(10 b)."""
    y, x = F.log("flux"), F.col("temp_c")
    return (
        readings.filter("flux > 0")
        .groupBy("tower_id")
        .agg(
            F.count("*").alias("n"),
            F.regr_intercept(y, x).alias("a"),
            F.regr_slope(y, x).alias("b"),
        )
        .withColumn("q10", F.exp(F.col("b") * 10))
    )


def partition_nee(readings: DataFrame, fit: DataFrame) -> DataFrame:
    """Split the net flux: respiration from the fit, uptake is respiration less net flux.

    A tower without a fit keeps its readings, with neither part.
    """
    return (
        readings.join(fit.select("tower_id", "a", "b"), "tower_id", "left")
        .withColumn("respiration", F.exp(F.col("a") + F.col("b") * F.col("temp_c")))
        .withColumn("uptake", F.col("respiration") - F.col("flux"))
        .drop("a", "b")
    )
