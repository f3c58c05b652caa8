"""Comparable history: "on a day like this, what happens?" for every target at once.

The search widens in five nested rungs, and the first that is deep enough answers. Two facts
keep it from meeting every target with every past service:

* A rung reads only the newest few matches, so each slot of history (one route, origin, time,
  day type, season and long-weekend flag) is cut to the rows any target could ever read. With
  one date left out and at most k rows of one date usable, those are the k newest rows of
  each of its k + 1 newest dates. The cut is exact.
* A target's own date matters only if it is among those rows. All other targets of the same
  slot share one answer, which is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewait.functions.calendar import with_calendar
from tidewait.functions.claims import effective_axes, evidence_kind, evidence_of
from tidewait.functions.clock import (
    hhmm_minutes,
    local_hhmm,
    minutes_clamped,
    minutes_floor,
    minutes_hhmm,
)
from tidewait.functions.stats import upper_median_of
from tidewait.operators.reports import reported_departures
from tidewait.operators.services import SERVICE_KEY
from tidewait.params import DAY_TYPE_PARTNER, REPORTED_OUTCOMES, RUNGS, Params

SLOT = ["route", "origin", "depart_hhmm", "day_type", "season", "long_weekend"]
MATCH_COLUMNS = [
    "service_date", "scheduled", "service_id", "depart_hhmm", "outcome", "filled", "left_behind",
    "left_full", "filled_at", "method", "day_type", "season",
]


def partner_day_type(day_type: Column) -> Column:
    pairs = [F.lit(x) for kv in DAY_TYPE_PARTNER.items() for x in kv]
    return F.create_map(*pairs)[day_type]


def known_records(records: DataFrame, day_types: list[str] | None = None,
                  season: str | None = None, exclude_date: Column | None = None) -> DataFrame:
    """Services with a known outcome, optionally of given day types, season and other dates."""
    found = records.filter(F.col("outcome") != "unknown")
    if day_types is not None:
        found = found.filter(F.col("day_type").isin(*day_types))
    if season is not None:
        found = found.filter(F.col("season") == season)
    if exclude_date is not None:
        found = found.filter(F.col("service_date") != exclude_date)
    return found


def readable_history(records: DataFrame, cap: int) -> DataFrame:
    """The rows of each slot that some target could read under a cap."""
    newest = [F.col("scheduled").desc(), F.col("service_id").desc()]
    per_date = W.partitionBy(*SLOT, "service_date").orderBy(*newest)
    per_slot = W.partitionBy(*SLOT).orderBy(F.col("service_date").desc())
    few = (
        known_records(records)
        .select(*dict.fromkeys([*SLOT, *MATCH_COLUMNS]))
        .withColumn("_r", F.row_number().over(per_date))
        .filter(F.col("_r") <= cap)
    )
    return (
        few.withColumn("_d", F.dense_rank().over(per_slot))
        .filter(F.col("_d") <= cap + 1)
        .drop("_r", "_d")
    )


def rung_of(params: Params) -> Column:
    """Number of the narrowest rung a candidate enters for a target (1 to 5)."""
    same_type = F.col("c.day_type") == F.col("t.day_type")
    near = F.abs(F.col("c.minutes") - F.col("t.minutes")) <= params.tolerance_minutes
    same_weekend = F.col("c.long_weekend") == F.col("t.long_weekend")
    same_season = F.col("c.season") == F.col("t.season")
    return (
        F.when(same_type & near & same_weekend & same_season, 1)
        .when(same_type & near & same_weekend, 2)
        .when(same_type & same_weekend, 3)
        .when(same_type, 4)
        .otherwise(5)
    )


def walk_rungs(targets: DataFrame, records: DataFrame, params: Params) -> DataFrame:
    """Shared answers: the matches of the first rung that is deep enough, else of the last.

    targets(route, origin, service_date, depart_hhmm). One row per slot and left-out date with
    rung (1 to 5), matches, at most `max_samples` structs, newest first, and dates, the targets
    it answers. Figures are worked out on these rows; `per_target` hands them out after.
    """
    cap = params.max_samples
    wanted = with_calendar(targets.select(*SERVICE_KEY).distinct())
    history = readable_history(records, cap).withColumn("minutes", hhmm_minutes(F.col("depart_hhmm")))

    slots = wanted.select(*SLOT).distinct().withColumn("minutes", hhmm_minutes(F.col("depart_hhmm")))
    asked = slots.withColumn(
        "match_type", F.explode(F.array("day_type", partner_day_type(F.col("day_type"))))
    )
    candidate = F.struct(
        F.col("c.service_date").alias("service_date"), F.col("c.scheduled").alias("scheduled"),
        F.col("c.service_id").alias("service_id"), rung_of(params).alias("rung"),
        *[F.col(f"c.{n}").alias(n) for n in MATCH_COLUMNS[3:]],
    )
    near = (
        asked.alias("t")
        .join(
            history.alias("c"),
            (F.col("t.route") == F.col("c.route")) & (F.col("t.origin") == F.col("c.origin"))
            & (F.col("t.match_type") == F.col("c.day_type"))
            & (F.abs(F.col("c.minutes") - F.col("t.minutes")) <= params.wide_tolerance_minutes),
        )
        .select(*[F.col(f"t.{k}").alias(k) for k in SLOT], candidate.alias("candidate"))
    )
    pools = near.groupBy(*SLOT).agg(
        F.sort_array(F.collect_list("candidate"), asc=False).alias("pool")
    )
    # Dates among a slot's own candidates; for any other date nothing has to be left out.
    met = pools.select(
        *SLOT,
        F.explode(F.array_distinct(F.transform("pool", lambda c: c["service_date"]))).alias("service_date"),
    )
    dated = wanted.join(met.withColumn("excluded", F.col("service_date")), [*SLOT, "service_date"], "left")
    # One answer per slot and excluded date, shared by every target that agrees on both.
    shared = (
        dated.groupBy(*SLOT, "excluded")
        .agg(F.collect_set("service_date").alias("dates"))
        .join(pools, SLOT, "left")
    )
    others = F.filter(
        F.coalesce("pool", F.array()),
        lambda c: F.col("excluded").isNull() | (c["service_date"] != F.col("excluded")),
    )

    def newest_upto(rung: int) -> Column:
        return F.slice(F.filter("others", lambda c: c["rung"] <= rung), 1, cap)

    rungs = F.array(*[newest_upto(r) for r in range(1, len(RUNGS) + 1)])
    deep = F.array_position(
        F.transform("rungs", lambda m: F.size(m) >= params.min_sample), True
    ).cast("int")
    answered = (
        shared.withColumn("others", others)
        .withColumn("rungs", rungs)
        .withColumn("rung", F.when(deep > 0, deep).otherwise(len(RUNGS)))
        .withColumn("matches", F.element_at("rungs", F.col("rung")))
    )
    return answered.select(*SLOT, "dates", "rung", "matches")


def per_target(answers: DataFrame) -> DataFrame:
    """One row per target from shared answers."""
    return answers.withColumn("service_date", F.explode("dates")).drop("dates")


def outcome_counts(matches: Column) -> dict[str, Column]:
    """How many matches ended each way, zeros included."""

    def count(name: str) -> Column:
        return F.size(F.filter(matches, lambda m: m["outcome"] == name))

    return {name: count(name) for name in REPORTED_OUTCOMES}


def axis_counts(matches: Column) -> dict[str, Column]:
    """Both axes over one pool: had_space + filled + cancelled make n, and left_behind +
    took_everyone + unresolved make filled."""

    def count(test) -> Column:
        return F.size(F.filter(matches, lambda m: F.coalesce(test(m), F.lit(False))))

    def axes(m):
        return effective_axes(m["filled"], m["left_behind"], m["outcome"])

    ran = lambda m: m["outcome"] != "cancelled"
    full = lambda m: ran(m) & F.coalesce(axes(m)[0], F.lit(False))
    return {
        "had_space": count(lambda m: ran(m) & ~F.coalesce(axes(m)[0], F.lit(False))),
        "filled_count": count(full),
        "cancelled_count": count(lambda m: m["outcome"] == "cancelled"),
        "left_behind_count": count(lambda m: full(m) & axes(m)[1]),
        "took_everyone": count(lambda m: full(m) & ~axes(m)[1]),
        "unresolved": count(lambda m: full(m) & axes(m)[1].isNull()),
        "board_reported": count(lambda m: m["left_full"].isNotNull()),
        "sharpened": count(
            lambda m: m["left_full"].isNotNull() & evidence_kind(m["method"]).isin("frames", "report")
        ),
    }


def typical_fill(matches: Column) -> Column:
    """Upper median of the minutes before departure at which the matches filled."""
    gaps = F.array_compact(
        F.transform(matches, lambda m: minutes_clamped(m["scheduled"], m["filled_at"]))
    )
    return upper_median_of(gaps)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))


def relaxations(rung: Column, day_type: Column, params: Params) -> Column:
    """What each widening step up to the used rung says, in order; empty on the first rung."""
    steps = [F.lit(t) for t in params.rung_words.values()]
    grouped = F.concat(
        F.lit("widened to similar day types ("), day_type, F.lit(", "),
        partner_day_type(day_type), F.lit(")"),
    )
    return F.slice(F.array(*steps, grouped), F.lit(1), rung - 1)


def unknown_counts(records: DataFrame) -> DataFrame:
    """Unknown outcomes per (route, origin, day_type)."""
    return (
        records.filter(F.col("outcome") == "unknown")
        .groupBy("route", "origin", "day_type")
        .agg(F.count(F.lit(1)).alias("unknown"))
    )


def with_unknown_excluded(answers: DataFrame, records: DataFrame) -> DataFrame:
    """Add unknown_excluded: unknowns of the day types of the rung used, nothing else asked."""
    unknown = unknown_counts(records)
    own = unknown.withColumnRenamed("unknown", "_own")
    partner = unknown.select(
        "route", "origin", partner_day_type(F.col("day_type")).alias("day_type"),
        F.col("unknown").alias("_partner"),
    )
    key = ["route", "origin", "day_type"]
    joined = answers.join(own, key, "left").join(partner, key, "left")
    extra = F.when(F.col("rung") == len(RUNGS), F.coalesce("_partner", F.lit(0))).otherwise(0)
    return joined.withColumn(
        "unknown_excluded", F.coalesce("_own", F.lit(0)) + extra
    ).drop("_own", "_partner")


def distribution(targets: DataFrame, records: DataFrame, params: Params) -> DataFrame:
    """The full "day like this" answer for each target."""
    answers = walk_rungs(targets, records, params)
    m = F.col("matches")
    n = F.size(m)
    counts = outcome_counts(m)
    axes = axis_counts(m)
    fill = typical_fill(m)
    tallied = answers.withColumns(
        {
            "n": n,
            **{f"n_{k}": v for k, v in counts.items()},
            **axes,
            "sufficient": n >= params.min_sample,
            "match_level": F.element_at(F.array(*[F.lit(r) for r in RUNGS]), F.col("rung")),
            "relaxations": relaxations(F.col("rung"), F.col("day_type"), params),
            "evidence": evidence_of(F.transform(m, lambda x: evidence_kind(x["method"]))),
            "fill_minutes_before": fill,
        }
    )
    shares = {f"share_{k}": share(F.col(f"n_{k}"), F.col("n")) for k in REPORTED_OUTCOMES}
    shared = tallied.withColumns(
        {
            **shares,
            "filled_share": share(F.col("filled_count"), F.col("n")),
            "fill_local": minutes_hhmm(
                hhmm_minutes(F.col("depart_hhmm")) - F.col("fill_minutes_before")
            ),
        }
    )
    return per_target(with_unknown_excluded(shared, records))


def outlook(boarded_share: Column, n: Column, sufficient: Column, params: Params) -> Column:
    return (
        F.when(~sufficient | (n == 0), "")
        .when(boarded_share >= params.outlook_room, "room most days")
        .when(boarded_share >= params.outlook_tossup, "toss-up")
        .otherwise("expect to wait")
    )


def day_board(targets: DataFrame, records: DataFrame, params: Params) -> DataFrame:
    """Every service of every asked date, each answered from its own history."""
    answers = walk_rungs(targets, records, params)
    m = F.col("matches")
    counts = outcome_counts(m)
    rows = answers.withColumns(
        {
            "n": F.size(m),
            **{f"n_{k}": v for k, v in counts.items()},
            "filled_count": axis_counts(m)["filled_count"],
            "fill_minutes_before": typical_fill(m),
            "match_level": F.element_at(F.array(*[F.lit(r) for r in RUNGS]), F.col("rung")),
        }
    )
    n = F.col("n")
    rows = rows.withColumns(
        {
            "boarded_share": share(F.col("n_boarded"), n),
            "filled_share": share(F.col("filled_count"), n),
            "sufficient": n >= params.min_sample,
            "relaxed": (n > 0) & (F.col("rung") > 1),
            "arrive_by": minutes_hhmm(
                hhmm_minutes(F.col("depart_hhmm")) - F.col("fill_minutes_before")
            ),
        }
    )
    seen = rows.withColumn("outlook", outlook(F.col("boarded_share"), n, F.col("sufficient"), params))
    return per_target(seen.drop("matches"))


# What a sample shows of its record besides the outcome.
SAMPLE_DETAILS = (
    "day_type", "season", "peak_queue", "queue_at_departure", "carryover", "confidence", "queue_truncated",
    "peak_band", "queue_started_at", "cleared_at",
)


def samples(targets: DataFrame, records: DataFrame, params: Params, tags: DataFrame | None = None) -> DataFrame:
    """The dates an answer rests on, one row per listed match, with the record's details under
    `sample_` names and, given tags(service_date, tag), the sorted tags of its date."""
    answers = per_target(walk_rungs(targets, records, params))
    listed = answers.select(
        *SERVICE_KEY, F.posexplode("matches").alias("place", "m")
    )
    filled, left = effective_axes(F.col("m.filled"), F.col("m.left_behind"), F.col("m.outcome"))
    shown = listed.select(
        *SERVICE_KEY, (F.col("place") + 1).alias("place"),
        F.col("m.service_id").alias("sample_id"),
        F.col("m.service_date").alias("sample_date"),
        F.col("m.depart_hhmm").alias("sample_hhmm"),
        F.col("m.outcome").alias("outcome"),
        filled.alias("filled"), left.alias("left_behind"),
        F.col("m.left_full").alias("left_full"),
        local_hhmm(F.col("m.filled_at"), params.zone).alias("filled_at_local"),
        minutes_clamped(F.col("m.scheduled"), F.col("m.filled_at")).alias("fill_minutes_before"),
        evidence_of(F.array(evidence_kind(F.col("m.method")))).alias("evidence"),
    )
    known = [c for c in SAMPLE_DETAILS if c in records.columns]
    details = records.select(F.col("service_id").alias("sample_id"), *[F.col(c).alias(f"sample_{c}") for c in known])
    shown = shown.join(details, "sample_id", "left")
    if tags is not None:
        dated = tags.groupBy(F.col("service_date").alias("sample_date")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
        shown = shown.join(dated, "sample_date", "left")
    return shown


def collection_status(targets: DataFrame, records: DataFrame, reports: DataFrame,
                      params: Params, limit: int = 6) -> tuple[DataFrame, DataFrame]:
    """(totals, listed) of equivalent services: same origin, day type and time of day.

    Totals come from per-slot counts; the listed ones from each slot's newest `limit`, which
    are all any nearby slot can list.
    """
    slot = ["route", "origin", "day_type", "depart_hhmm"]
    per_slot = records.groupBy(*slot).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("outcome") == "unknown", 1)).alias("unknown"),
        F.count("departed_at").alias("timed"),
        F.min("service_date").alias("since"),
    )
    worth = records.filter((F.col("outcome") != "unknown") | F.col("departed_at").isNotNull())
    newest = [F.col("scheduled").desc(), F.col("service_id").desc()]
    top = worth.withColumn("_r", F.row_number().over(W.partitionBy(*slot).orderBy(*newest))).filter(
        F.col("_r") <= limit
    ).drop("_r")
    asked = with_calendar(targets.select(*SERVICE_KEY).distinct()).select(
        "route", "origin", "day_type", F.col("depart_hhmm").alias("target_hhmm"),
        hhmm_minutes(F.col("depart_hhmm")).alias("target_minutes"),
    ).distinct()
    key = ["route", "origin", "day_type"]
    close = F.abs(hhmm_minutes(F.col("depart_hhmm")) - F.col("target_minutes")) <= params.tolerance_minutes
    totals = asked.join(per_slot, key).filter(close).groupBy(*key, "target_hhmm").agg(
        (F.sum("n") - F.sum("unknown")).alias("recorded"),
        F.sum("unknown").alias("unknown"),
        F.sum("timed").alias("timed"),
        F.min("since").alias("since"),
    )
    ranked = asked.join(top, key).filter(close).withColumn(
        "place", F.row_number().over(W.partitionBy(*key, "target_hhmm").orderBy(*newest))
    ).filter(F.col("place") <= limit)
    told = reported_departures(reports)
    listed = ranked.join(told, SERVICE_KEY, "left").withColumn(
        "actual", F.coalesce("departed_at", "reported_departed_at")
    )
    return totals, listed.select(
        *key, "target_hhmm", "place", "service_id", "service_date", "depart_hhmm", "outcome",
        local_hhmm(F.col("actual"), params.zone).alias("departed_local"),
        F.coalesce("departed_source", F.when(F.col("actual").isNotNull(), F.lit("report"))).alias("departed_source"),
        minutes_floor(F.col("actual"), F.col("scheduled")).alias("minutes_late"),
        local_hhmm(F.col("filled_at"), params.zone).alias("filled_at_local"),
        evidence_of(F.array(evidence_kind(F.col("method")))).alias("evidence"),
        *[c for c in ("peak_queue",) if c in records.columns],
    )
