"""Collection health and label-free scores of how far the readings can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewait.functions.clock import add_minutes, iso_text, local_date, seconds_between
from tidewait.functions.stats import rank_correlation, value_counts
from tidewait.operators.intervals import interval_join
from tidewait.operators.services import SERVICE_KEY
from tidewait.params import Params

# What counts as a rise, a clear and a believable step.
RISING_RHO = 0.3
DROP_RATIO = 0.5
DROP_FLOOR = 2
IMPLAUSIBLE_STEP = 20
STEP_GAP_MINUTES = 25


def capture_totals(frames: DataFrame, board: DataFrame, readings: DataFrame, services: DataFrame,
                   spend: DataFrame, now: Column, params: Params, *, window_days: int,
                   cameras: int, forecasts: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row of collection health over a window, and the problems it shows.

    services(service_date, outcome) is the timetable of the window with NULL or `unknown`
    where nothing is known; spend(created_at, cost_usd). `forecasts` are the configured forecast feeds by name
    (issued_at, fetch_status); each is judged by its newest good issue, as an old forecast goes on being served. Captures, their
    backlog and missing cameras are judged only where cameras are polled (Params.scheduled_capture); nothing is expected
    of cameras asked on demand. Each table is reduced to one row in a single pass, and the single rows are folded into one.
    """
    feeds = forecasts or {}
    since = add_minutes(now, -window_days * 1440)
    first_day = F.to_date(since)
    ok, recent = F.col("status") == "ok", F.col("captured_at") >= since
    captured = frames.groupBy().agg(
        F.count(F.when(ok & recent, 1)).alias("captures"),
        F.count(F.when((F.col("status") == "error") & recent, 1)).alias("failed"),
        F.max(F.when(ok, F.col("captured_at"))).alias("last_capture_at"),
    )
    scraped = board.filter(F.col("observed_at") >= since).groupBy().agg(
        F.count(F.when(F.col("fetch_status") != "not_published", 1)).alias("board_total"),
        F.count(F.when(F.col("fetch_status") == "ok", 1)).alias("board_ok"),
        F.count(F.when((F.col("fetch_status") == "ok") & F.col("hhmm").isNotNull(), 1)).alias("board_usable"),
    )
    by_model = readings.filter(F.col("version") == params.model_version)
    read = by_model.groupBy().agg(
        F.count(F.lit(1)).alias("read"), F.count(F.when(~F.col("usable"), 1)).alias("unusable")
    )
    waiting = (
        frames.filter(ok & F.col("path").isNotNull())
        .join(by_model.select("frame_id").distinct(), "frame_id", "left_anti")
        .groupBy().agg(F.count(F.lit(1)).alias("awaiting"))
    )
    covered = services.filter(F.col("service_date").between(first_day, F.to_date(now))).groupBy().agg(
        F.count(F.lit(1)).alias("services"),
        F.count(F.when(F.col("outcome") != "unknown", 1)).alias("with_record"),
    )
    month = F.date_trunc("month", now)
    spent = spend.filter((F.col("created_at") >= month) & (F.col("created_at") <= now)).groupBy().agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("month_spend")
    )
    issued = [
        feed.filter(F.col("fetch_status") == "ok").groupBy().agg(F.max("issued_at").alias(f"{name}_issued_at"))
        for name, feed in feeds.items()
    ]
    sides = captured
    for other in (scraped, read, waiting, covered, spent, *issued):
        sides = sides.unionByName(other, allowMissingColumns=True)
    one = sides.groupBy().agg(*[F.max(c).alias(c) for c in sides.columns])
    polled = params.scheduled_capture
    expected = (1440 // max(1, params.poll_minutes)) * window_days * max(1, cameras) if polled else 0
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    figures = one.withColumns(
        {
            "expected": F.lit(expected),
            "capture_rate": ratio(F.col("captures"), F.lit(expected)),
            "board_rate": ratio(F.col("board_ok"), F.col("board_total")),
            "unusable_share": ratio(F.col("unusable"), F.col("read")),
            "coverage": F.coalesce(ratio(F.col("with_record"), F.col("services")), F.lit(0.0)),
            "month_spend": F.round("month_spend", 4),
        }
    )
    percent = lambda c: F.concat(F.round(F.col(c) * 100).cast("int").cast("string"), F.lit("%"))
    late = params.poll_minutes * 4 * 60
    camera_problems = [
        F.when(F.lit(cameras == 0), F.lit("no cameras are configured")),
        F.when(F.col("capture_rate") < 0.95, F.concat(F.lit("captures at "), percent("capture_rate"))),
        F.when(
            seconds_between(now, F.col("last_capture_at")) > late,
            F.concat(F.lit("no capture since "), iso_text(F.col("last_capture_at"))),
        ),
        F.when(
            F.col("awaiting") > params.max_frames_per_run * 4,
            F.concat(F.col("awaiting").cast("string"), F.lit(" frames wait to be read")),
        ),
    ]
    feed_problems = [
        F.when(F.col(f"{name}_issued_at").isNull(), F.lit(f"no {name} forecast has been read yet")).when(
            seconds_between(now, F.col(f"{name}_issued_at")) > params.overdue_forecast_hours * 3600,
            F.concat(F.lit(f"the {name} forecast is stale, last issued "), iso_text(F.col(f"{name}_issued_at"))),
        )
        for name in feeds
    ]
    problems = [
        *(camera_problems if polled else []),
        F.when(F.col("board_rate") < 0.95, F.concat(F.lit("board at "), percent("board_rate"))),
        F.when((F.col("board_ok") > 0) & (F.col("board_usable") == 0), F.lit("board names no service")),
        F.when(F.col("board_total") == 0, F.lit("no board readings")),
        F.when((F.lit(params.monthly_budget_usd) > 0) & (F.col("month_spend") > params.monthly_budget_usd * 0.9), F.lit("near the budget")),
        F.when(
            (F.col("services") > 0) & (F.col("coverage") < 0.90),
            F.concat(F.lit("records for "), percent("coverage")),
        ),
        *feed_problems,
    ]
    return figures.withColumn("problems", F.array_compact(F.array(*problems)))


def capture_strip(frames: DataFrame, readings: DataFrame, asked_days: DataFrame, params: Params,
                  expected: int) -> DataFrame:
    """One row per asked day, missing days included: counts and a one-word state.

    asked_days(service_date) are the days to show.
    """
    by_model = readings.filter(F.col("version") == params.model_version).select("frame_id", "usable")
    days = (
        frames.select("frame_id", "service_date", "status")
        .join(asked_days, "service_date", "left_semi")
        .join(by_model, "frame_id", "left")
        .groupBy("service_date")
        .agg(
            F.count(F.when(F.col("status") == "ok", 1)).alias("ok"),
            F.count(F.when(F.col("status") == "error", 1)).alias("failed"),
            F.count(F.when(~F.col("usable"), 1)).alias("unusable"),
        )
    )
    strip = asked_days.join(days, "service_date", "left").select(
        "service_date", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ok", "failed", "unusable")]
    )
    nothing = (F.col("ok") == 0) & (F.col("failed") == 0)
    state = (
        F.when(nothing & F.lit(expected == 0), "none")
        .when(F.lit(expected > 0) & (F.col("ok") < expected * 0.5), "bad")
        .when((F.col("failed") > 0) | (F.col("unusable") > 0), "degraded")
        .when(F.col("ok") > 0, "good")
        .otherwise("none")
    )
    return strip.withColumn("state", state)


def latest_reading(readings: DataFrame, version: str, keys: list[str] | None = None) -> DataFrame:
    """The most recent reading of a version, overall or per key."""
    keys = keys or []
    rest = [c for c in readings.columns if c not in keys]
    return (
        readings.filter(F.col("version") == version)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct("captured_at", "frame_id")).alias("r"))
        .select(*keys, "r.*")
    )


def reading_coverage(frames: DataFrame, readings: DataFrame, version: str) -> DataFrame:
    """Frames, read frames and usable readings per terminal."""
    stored = frames.filter(F.col("status") == "ok").groupBy("terminal").agg(
        F.count(F.lit(1)).alias("frames")
    )
    read = readings.filter(F.col("version") == version).groupBy("terminal").agg(
        F.count(F.lit(1)).alias("observed"), F.count(F.when(F.col("usable"), 1)).alias("usable")
    )
    return stored.join(read, "terminal", "left").select(
        "terminal", "frames", F.coalesce("observed", F.lit(0)).alias("observed"),
        F.coalesce("usable", F.lit(0)).alias("usable"),
    )


def unusable_reasons(readings: DataFrame, version: str) -> DataFrame:
    return (
        readings.filter((F.col("version") == version) & ~F.col("usable"))
        .groupBy("terminal", F.coalesce("visibility", F.lit("unknown")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def service_coverage(services: DataFrame, records: DataFrame) -> DataFrame:
    """Services and those with a known outcome, per origin."""
    known = records.filter(F.col("outcome") != "unknown").select(*SERVICE_KEY, F.lit(1).alias("_k"))
    return services.join(known, SERVICE_KEY, "left").groupBy("origin").agg(
        F.count(F.lit(1)).alias("services"), F.count("_k").alias("with_outcome")
    )


def departure_drops(services: DataFrame, readings: DataFrame, board_departures: DataFrame,
                    params: Params) -> DataFrame:
    """Queue before and after each departure the board timed, and whether it cleared."""
    timed = services.join(
        board_departures.select(
            "route", F.col("terminal").alias("origin"), "service_date",
            F.col("hhmm").alias("depart_hhmm"), "departed_at",
        ),
        SERVICE_KEY,
    )
    after_from = add_minutes(F.col("departed_at"), params.settle_minutes)
    after_to = add_minutes(F.col("departed_at"), params.post_window_minutes)
    before_from = add_minutes(F.col("scheduled"), -params.lookback_minutes)
    spans = timed.withColumns(
        {
            "terminal": F.col("origin"),
            "_before_from": before_from, "_after_from": after_from, "_after_to": after_to,
            "_from": F.least(before_from, after_from), "_to": F.greatest(F.col("scheduled"), after_to),
        }
    )
    counted = readings.filter(F.col("usable") & F.col("vehicle_count").isNotNull())
    met = interval_join(counted, spans, ["terminal"], "captured_at", "_from", "_to", salts=params.salts)
    ts = F.col("captured_at")
    seen = met.groupBy(*SERVICE_KEY).agg(
        F.max(F.when(ts.between(F.col("_before_from"), F.col("scheduled")), F.col("vehicle_count"))).alias("before"),
        F.min_by(
            "vehicle_count",
            F.when(ts.between(F.col("_after_from"), F.col("_after_to")), F.struct("captured_at", "frame_id")),
        ).alias("after"),
    )
    b, a = F.col("before"), F.col("after")
    return timed.select(*SERVICE_KEY, "departed_at").join(seen, SERVICE_KEY, "left").withColumns(
        {
            "ratio": F.when(b != 0, F.round(a / b, 4)),
            "dropped": a <= F.greatest(F.lit(float(DROP_FLOOR)), b * DROP_RATIO),
        }
    ).withColumn("dropped", F.when(b.isNotNull(), F.col("dropped")))


def service_trends(services: DataFrame, readings: DataFrame, params: Params) -> DataFrame:
    """Rank correlation of count against time in each service's run-up."""
    spans = services.withColumns(
        {
            "terminal": F.col("origin"),
            "_from": add_minutes(F.col("scheduled"), -params.lookback_minutes),
        }
    )
    counted = readings.filter(F.col("usable") & F.col("vehicle_count").isNotNull())
    met = interval_join(counted, spans, ["terminal"], "captured_at", "_from", "scheduled",
                        salts=params.salts)
    timed = met.withColumn("_at", F.unix_seconds("captured_at"))
    return rank_correlation(timed, SERVICE_KEY, "_at", "vehicle_count").filter(F.col("n") >= 3)


def reading_steps(readings: DataFrame, keys: list[str]) -> DataFrame:
    """|count - previous count| of neighbouring readings at most 25 minutes apart.

    A terminal's whole history is one series, so it is never windowed as one: readings are
    split by hour, and each hour is handed the last reading of the hour before it. The gap
    limit makes that the only earlier reading that can matter.
    """
    base = readings.select(
        *keys, "captured_at", "frame_id", "vehicle_count",
        F.floor(F.unix_seconds("captured_at") / 3600).cast("long").alias("_hour"),
    )
    order = F.struct("captured_at", "frame_id")
    carried = (
        base.groupBy(*keys, "_hour")
        .agg(F.max_by(F.struct("captured_at", "frame_id", "vehicle_count"), order).alias("r"))
        .select(*keys, (F.col("_hour") + 1).alias("_hour"), "r.*", F.lit(True).alias("_carried"))
    )
    series = base.withColumn("_carried", F.lit(False)).unionByName(carried)
    hour = W.partitionBy(*keys, "_hour").orderBy("captured_at", "frame_id")
    gap = seconds_between(F.col("captured_at"), F.lag("captured_at").over(hour))
    stepped = series.withColumns(
        {
            "gap_seconds": gap,
            "step": F.abs(F.col("vehicle_count") - F.lag("vehicle_count").over(hour)),
        }
    )
    return stepped.filter(
        ~F.col("_carried") & (F.col("gap_seconds") > 0)
        & (F.col("gap_seconds") <= STEP_GAP_MINUTES * 60)
    ).drop("_hour", "_carried")


def share_true(flag: Column) -> Column:
    return F.avg(F.when(flag.isNotNull(), flag.cast("int")))


def exact_median(values: DataFrame, column: str, low: float, high: float, cells: int = 10_000) -> DataFrame:
    """One row `median` of a bounded column, or NULL: equal values are counted, the counts fall into `cells` equal
    cells, and only the cells that hold the middle are put in order."""
    v = F.col(column)
    folded = values.filter(v.isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "cell", F.floor((v - low) / (high - low) * cells)
    )
    earlier = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    placed = folded.groupBy("cell").agg(F.sum("n").alias("n")).withColumns(
        {"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "total": F.sum("n").over(W.partitionBy())}
    )
    first, second = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = placed.filter((F.col("before") <= second) & (F.col("before") + F.col("n") > first)).select("cell", "before", "total")
    inside = W.partitionBy("cell").orderBy(column).rowsBetween(W.unboundedPreceding, -1)
    start = folded.join(middle, "cell").withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    at = lambda rank: F.max(F.when((F.col("start") <= rank) & (F.col("start") + F.col("n") > rank), v))
    return start.groupBy().agg(((at(first) + at(second)) / 2).alias("median"))


def trend_scores(trends: DataFrame) -> DataFrame:
    rho = F.col("rho")
    shares = trends.groupBy().agg(
        F.count(F.lit(1)).alias("trends"), F.round(share_true(rho > RISING_RHO), 4).alias("trend_score")
    )
    middle = exact_median(trends.select(F.round(rho, 9).alias("rho")), "rho", -1.0, 1.0)
    both = shares.unionByName(middle, allowMissingColumns=True)
    return both.groupBy().agg(
        F.max("trends").alias("trends"), F.max("trend_score").alias("trend_score"), F.round(F.max("median"), 4).alias("median_rho")
    )


def drop_scores(drops: DataFrame) -> DataFrame:
    return drops.groupBy().agg(
        F.count(F.lit(1)).alias("drops"), F.round(share_true(F.col("dropped")), 4).alias("drop_score")
    )


def noise_scores(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Share of believable steps and the true median step, from counts of equal steps."""
    folded = value_counts(steps, keys, "step")
    return folded.groupBy(*keys).agg(
        F.sum("n").alias("steps"),
        F.round(
            F.sum(F.when(F.col("step") <= IMPLAUSIBLE_STEP, F.col("n")).otherwise(0)) / F.sum("n"), 4
        ).alias("noise_score"),
        F.percentile("step", F.lit(0.5), F.col("n")).alias("median_step"),
    )


def observed_range(frames: DataFrame, board: DataFrame, params: Params) -> DataFrame:
    """First and last local date with any good frame or board row."""
    seen = frames.filter(F.col("status") == "ok").select(
        local_date(F.col("captured_at"), params.zone).alias("day")
    )
    told = board.filter(F.col("fetch_status") == "ok").select(F.col("service_date").alias("day"))
    return seen.unionByName(told).groupBy().agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day")
    ).filter(F.col("first_day").isNotNull())
