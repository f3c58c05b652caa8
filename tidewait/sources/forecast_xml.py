"""Forecast documents as rows: a whole table of XML texts at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewait.functions.clock import local_date
from tidewait.functions.text import decode_references
from tidewait.functions.wind import next_weekday, period_date, wind_band, wind_speed
from tidewait.params import Params

STAMP = "struct<_zone:string,timeStamp:string>"
MARINE_SCHEMA = (
    f"area string, dateTime array<{STAMP}>, "
    f"regularForecast struct<dateTime:array<{STAMP}>,location:array<struct<_name:string,"
    "weatherCondition:struct<wind:string,weatherVisibility:string,periodOfCoverage:string>>>>, "
    "extendedForecast struct<location:array<struct<_name:string,weatherCondition:"
    "struct<forecastPeriod:array<struct<_VALUE:string,_name:string>>>>>>, _corrupt string"
)
SHORE_SCHEMA = (
    "location struct<name:string,region:string>, "
    f"forecastGroup struct<dateTime:array<{STAMP}>,forecast:array<struct<"
    "period:struct<_VALUE:string,_textForecastName:string>,textSummary:string,"
    "abbreviatedForecast:struct<textSummary:string,pop:string>,"
    "temperatures:struct<temperature:array<struct<_VALUE:string,_class:string>>>>>>, "
    f"dateTime array<{STAMP}>, _corrupt string"
)
# What may stand before a document type: declarations, comments and blanks, however long.
DOCTYPE = r"(?is)\A\x{FEFF}?(?:\s++|<\?.*?\?>|<!--.*?-->)*+<!DOCTYPE"
WARNINGS = r"""(?s)<warnings\b(?:[^>"'/]|/(?!>)|"[^"]*"|'[^']*')*+(?:/>|>.*?</warnings>)"""
# One start tag with the text that stands directly behind it, if the tag is not closed in itself.
STARTED = r"""(?s)<[A-Za-z_](?:[^>"']|"[^"]*"|'[^']*')*+>[^<]*"""
ATTRIBUTE = r"""(?s)[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*')"""
# The attributes a warning may be named by, in the order they are read.
SPOKEN = ("name", "type", "event", "priority")
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once per row; an expression named twice inside a lambda is run twice."""
    return F.transform(F.array(value), use)[0]


def _text(c: Column) -> Column:
    """Blanks run together; NULL if nothing is left."""
    return F.try_element_at(F.filter(F.array(F.trim(F.regexp_replace(c, r"\s+", " "))), lambda t: t != ""), F.lit(1))


def _stamps(stamps: Column, zone_is_utc: bool, digits: str) -> Column:
    """Well-formed stamps of the wanted zone, in document order."""
    wanted = F.filter(
        F.coalesce(stamps, F.array()),
        lambda s: ((s["_zone"] == "UTC") == zone_is_utc) & F.trim(s["timeStamp"]).rlike(digits),
    )
    return F.try_element_at(F.transform(wanted, lambda s: F.trim(s["timeStamp"])), F.lit(1))


def _int(text: Column) -> Column:
    return _text(text).try_cast("double").cast("int")


def _parsed(documents: DataFrame, schema: str) -> DataFrame:
    """Documents with their parsed tree; a DOCTYPE, which can only stand before the root, is refused unread."""
    refused = F.col("xml").rlike(DOCTYPE)
    return documents.withColumn("_refused", refused).withColumn(
        "d", F.when(~refused, F.from_xml(F.col("xml"), schema, OPTIONS))
    )


def _pick(locations: Column, preferred: Column) -> Column:
    """The preferred location, else the first."""
    wanted = F.filter(
        locations, lambda x: F.lower(F.trim(x["_name"])) == F.lower(F.trim(preferred))
    )
    return F.coalesce(F.try_element_at(wanted, F.lit(1)), F.try_element_at(locations, F.lit(1)))


def warning_text(xml: Column) -> Column:
    """Everything named or written in and below the warnings element, distinct: of each element its name, type, event
    and priority, then the text before its first child. Text that follows a closed element belongs to none."""
    block = F.regexp_replace(F.regexp_extract(xml, WARNINGS, 0), r"(?s)<!--.*?-->|<!\[CDATA\[|\]\]>", "")

    of = lambda attributes, key: F.try_element_at(F.filter(attributes, lambda a: F.regexp_extract(a, r"\A[\w:.-]+", 0) == key), F.lit(1))
    value = lambda a: F.regexp_extract(a, r"""(?s)=\s*["'](.*)["']\z""", 1)

    def parted(piece: Column, tag: Column) -> Column:
        return F.struct(
            F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)).alias("attributes"),
            F.when(~tag.endswith("/>"), F.substring(piece, F.length(tag) + 1, F.length(piece))).alias("text"),
        )

    def spoken(piece: Column) -> Column:
        tag = F.regexp_extract(piece, r"""(?s)\A<(?:[^>"']|"[^"]*"|'[^']*')*+>""", 0)
        part = _once(tag, lambda t: parted(piece, t))
        return _once(part, lambda p: F.array(*[value(of(p["attributes"], k)) for k in SPOKEN], p["text"]))

    pieces = F.flatten(F.transform(F.regexp_extract_all(block, F.lit(STARTED), F.lit(0)), spoken))
    words = F.transform(F.array_compact(pieces), lambda p: F.trim(F.regexp_replace(decode_references(p), r"\s+", " ")))
    return F.nullif(F.array_join(F.array_distinct(F.filter(words, lambda w: w != "")), " · "), F.lit(""))


def marine_forecast_rows(documents: DataFrame, params: Params) -> DataFrame:
    """One row per forecast date, or one `error` row, from documents(doc_id, xml, preferred).

    The regular sentence covers its issue date and the next; extended weekdays mean the next
    one after the issue date and give way to a regular day.
    """
    parsed = _parsed(documents, MARINE_SCHEMA)
    stamp = F.coalesce(
        _stamps(F.col("d.regularForecast.dateTime"), True, r"^\d{12}$"),
        _stamps(F.col("d.dateTime"), True, r"^\d{12}$"),
    )
    regular = _pick(F.col("d.regularForecast.location"), F.col("preferred"))
    extended = _pick(F.col("d.extendedForecast.location"), F.col("preferred"))
    read = parsed.select(
        "doc_id", "_refused", F.col("d._corrupt").alias("_corrupt"), "xml",
        F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmm")).alias("issued_at"),
        _text(F.col("d.area")).alias("area"), regular.alias("r"), extended.alias("e"),
    ).withColumn("_issued", local_date(F.col("issued_at"), params.zone))
    condition = F.col("r.weatherCondition")
    told = F.struct(
        _text(condition["periodOfCoverage"]).alias("period"), _text(condition["wind"]).alias("wind"),
        _text(condition["weatherVisibility"]).alias("visibility"),
    )
    regular_days = F.when(
        condition.isNotNull(),
        _once(
            told,
            lambda t: F.array(
                *[
                    F.struct(
                        F.date_add("_issued", o).alias("service_date"), F.lit("regular").alias("kind"),
                        t["period"].alias("period"), t["wind"].alias("wind"), t["visibility"].alias("visibility"),
                    )
                    for o in (0, 1)
                ]
            ),
        ),
    )
    periods = F.transform(
        F.coalesce(F.col("e.weatherCondition.forecastPeriod"), F.array()),
        lambda p: F.struct(
            next_weekday(F.col("_issued"), F.split(F.lower(F.trim(p["_name"])), r"\s+")[0]).alias("service_date"),
            F.lit("extended").alias("kind"), p["_name"].alias("period"),
            _text(p["_VALUE"]).alias("wind"), F.lit(None).cast("string").alias("visibility"),
        ),
    )
    covered = F.when(
        condition.isNotNull(), F.array("_issued", F.date_add("_issued", 1))
    ).otherwise(F.array().cast("array<date>"))
    extended_days = F.filter(
        periods,
        lambda p: p["service_date"].isNotNull() & ~F.array_contains(covered, p["service_date"]),
    )
    days = F.when(
        F.col("issued_at").isNotNull(),
        F.concat(F.coalesce(regular_days, F.array()), extended_days),
    )
    listed = read.withColumn("days", days)
    problem = (
        F.when(F.col("_refused"), "document declares a DOCTYPE; refusing to parse")
        .when(F.col("_corrupt").isNotNull(), "not well-formed XML")
        .when(F.col("issued_at").isNull(), "no UTC issue time in the document")
        .when(F.size("days") == 0, "no forecast periods found")
    )
    # Read once per document: an expression beside a generator is run for each of its rows.
    warned = listed.withColumns({"error": problem, "warning": warning_text(F.col("xml"))})
    rows = warned.select(
        "doc_id", "issued_at", "area", F.col("r._name").alias("location"), "warning", "error",
        F.explode_outer(F.when(F.col("error").isNull(), F.col("days"))).alias("day"),
    )
    knots = wind_speed(F.col("wind"), params.fastest_wind_kt)
    return rows.select(
        "doc_id", "issued_at", "area", "location", "day.*", "warning",
        F.when(F.col("error").isNull(), "ok").otherwise("error").alias("fetch_status"), "error",
    ).withColumn("wind_max_kt", knots).withColumn(
        "band", F.when(F.col("error").isNull(), wind_band(F.col("wind_max_kt")))
    )


def shore_forecast_rows(documents: DataFrame) -> DataFrame:
    """One row per half-day, or one `error` row, from documents(doc_id, xml)."""
    parsed = _parsed(documents, SHORE_SCHEMA)
    group = F.col("d.forecastGroup")
    digits = r"^(\d{12}|\d{14})$"
    issued = F.coalesce(
        _stamps(group["dateTime"], True, digits), _stamps(F.col("d.dateTime"), True, digits)
    )
    local_day = _stamps(group["dateTime"], False, digits)
    read = parsed.select(
        "doc_id", "_refused", F.col("d._corrupt").alias("_corrupt"), group.isNull().alias("_no_group"),
        F.try_to_timestamp(F.substring(issued, 1, 12), F.lit("yyyyMMddHHmm")).alias("issued_at"),
        F.try_to_date(F.substring(local_day, 1, 8), "yyyyMMdd").alias("_day"),
        _text(F.col("d.location.name")).alias("station"),
        _text(F.col("d.location.region")).alias("region"),
        F.coalesce(group["forecast"], F.array()).alias("f"),
    )

    def told(f: Column) -> Column:
        temperature = lambda which: _int(
            F.try_element_at(
                F.filter(
                    F.coalesce(f["temperatures"]["temperature"], F.array()), lambda t: t["_class"] == which
                ),
                F.lit(1),
            )["_VALUE"]
        )
        return F.struct(
            F.coalesce(f["period"]["_textForecastName"], _text(f["period"]["_VALUE"])).alias("period"),
            _text(f["abbreviatedForecast"]["textSummary"]).alias("condition"),
            _int(f["abbreviatedForecast"]["pop"]).alias("pop"),
            temperature("high").alias("temp_high"), temperature("low").alias("temp_low"),
            _text(f["textSummary"]).alias("summary"),
        )

    def half_day(t: Column) -> Column:
        date, half = period_date(t["period"], F.col("_day"))
        rest = [t[c].alias(c) for c in ("period", "condition", "pop", "temp_high", "temp_low", "summary")]
        return F.struct(date.alias("service_date"), half.alias("kind"), *rest)

    halves = F.filter(F.transform(F.transform("f", told), half_day), lambda h: h["service_date"].isNotNull())
    listed = read.withColumn("halves", halves)
    problem = (
        F.when(F.col("_refused"), "document declares a DOCTYPE; refusing to parse")
        .when(F.col("_corrupt").isNotNull(), "not well-formed XML")
        .when(F.col("issued_at").isNull(), "no UTC issue time in the document")
        .when(F.col("_no_group"), "no forecast group in the document")
        .when(F.col("_day").isNull(), "no local issue date in the document")
        .when(F.size("halves") == 0, "no forecast periods found")
    )
    rows = listed.withColumn("error", problem).select(
        "doc_id", "issued_at", "station", "region", "error",
        F.explode_outer(F.when(F.col("error").isNull(), F.col("halves"))).alias("half"),
    )
    return rows.select(
        "doc_id", "issued_at", "station", "region", "half.*",
        F.when(F.col("error").isNull(), "ok").otherwise("error").alias("fetch_status"), "error",
    )
