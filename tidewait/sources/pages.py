"""Board and tracker pages read as text, a whole table of pages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewait.functions.claims import DEPARTED_NOTE
from tidewait.functions.clock import CLOCK_PATTERN, clock_to_24h, first_clock
from tidewait.functions.text import decode_references

# Wording of a published board.
STATUS_WORD = r"(?i)\b(cancell?ed|departed|upcoming|arrived|delayed)\b"
PERCENT = r"(\d{1,3})\s*%"
FULL_WORD = r"(?i)\bfull\b"
AVAILABLE_WORD = r"(?i)\bavailable|\bspace\b|\bremaining\b"
FOOTER = r"(?i)Last updated:|Refresh details|Ferry tracking"
TAB_LINE = "Departures"


def visible_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments out, every tag a line break."""
    text = html
    for tag in ("script", "style", "noscript"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"<[^>]+>", "\n")
    return F.regexp_replace(decode_references(text), r"[ \t\xa0]+", " ")


def publishes_departures(text: Column) -> Column:
    """Whether a line of the page is the departures tab itself."""
    return F.exists(F.split(text, "\n"), lambda line: F.trim(line) == TAB_LINE)


def _one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


FEW_TERMINALS = 10_000  # whose clocks, at most 1,440 each, are sent to every task


def _clocks_of(expected: DataFrame) -> DataFrame:
    """One row per terminal with its scheduled clocks, broadcast when their number has been checked."""
    times = expected.groupBy("terminal").agg(F.collect_set("depart_hhmm").alias("times"))
    return F.broadcast(times) if times.limit(FEW_TERMINALS + 1).count() <= FEW_TERMINALS else times


def _segments(text: Column, times: Column) -> Column:
    """Each scheduled clock of a text, in order, with what runs to the next scheduled one, up to the page's footer.

    A clock that is no scheduled departure stays part of the text around it. The whole text is walked inside its row."""
    clocks = F.regexp_extract_all(text, F.lit(CLOCK_PATTERN), F.lit(0))
    tails = F.slice(F.split(text, CLOCK_PATTERN, -1), F.lit(2), F.size(clocks))

    def piece(clock: Column, tail: Column) -> Column:
        return F.struct(clock.alias("clock"), tail.alias("tail"), F.get(F.array_intersect(F.array(first_clock(clock)), times), F.lit(0)).alias("hhmm"))

    def cut(pieces: Column) -> Column:
        numbered = F.transform(pieces, lambda p, i: F.struct(p["hhmm"].alias("hhmm"), (i + 1).alias("place")))
        starts = F.filter(numbered, lambda p: p["hhmm"].isNotNull())

        def entry(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1)["place"], F.size(pieces) + 1)
            tail = lambda p: F.when(p["hhmm"].isNotNull(), p["tail"]).otherwise(F.concat(p["clock"], p["tail"]))
            whole = F.array_join(F.transform(F.slice(pieces, start["place"], end - start["place"]), tail), "")
            return F.struct(start["hhmm"].alias("hhmm"), F.split(whole, FOOTER, 2)[0].alias("segment"))

        return F.transform(starts, entry)

    return F.flatten(F.transform(F.array(F.zip_with(clocks, tails, piece)), cut))


def _stated(hhmm: Column, segment: Column) -> Column:
    """What one entry of the board says: percentage, departure and note."""
    cancelled = F.lower(F.regexp_extract(segment, STATUS_WORD, 1)).isin("cancelled", "canceled")
    percent_text = F.regexp_extract(segment, PERCENT, 0)
    value = F.regexp_extract(segment, PERCENT, 1).try_cast("int")
    upto = F.regexp_instr(segment, F.lit(PERCENT)) - 1 + F.length(percent_text) + 40
    window = F.substring(segment, F.lit(1), upto)
    percent = F.when(
        value <= 100,
        F.when(window.rlike(FULL_WORD) & ~window.rlike(AVAILABLE_WORD), 100 - value).otherwise(value),
    )
    clock = [F.regexp_extract(segment, DEPARTED_NOTE, i) for i in (1, 2, 3)]
    departed = F.when(clock[0] != "", clock_to_24h(*clock))
    note = F.nullif(_one_space(segment), F.lit(""))
    return F.struct(
        hhmm.alias("hhmm"), F.when(~cancelled, percent).alias("percent"), F.when(~cancelled, departed).alias("departed"),
        F.when(cancelled, F.lit("cancelled")).otherwise(note).alias("note"),
    )


def board_rows_from_pages(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per page and scheduled service: percentage, departure and note.

    pages(page_id, terminal, html), expected(terminal, depart_hhmm). The board prints a service more than once; its entries
    are merged, the first that fills a field being kept, the longest note winning. All of it happens inside a page's
    row: no text is exploded, shuffled or gathered again.
    """
    text = pages.select("page_id", "terminal", visible_text(F.col("html")).alias("text"))
    cut = text.join(_clocks_of(expected), "terminal").select("page_id", "terminal", _segments(F.col("text"), F.col("times")).alias("_cut"))
    said = F.filter(F.transform("_cut", lambda e: _stated(e["hhmm"], e["segment"])), lambda e: e["percent"].isNotNull() | e["note"].isNotNull())

    def merged(hhmm: Column) -> Column:
        mine = F.filter("_said", lambda e: e["hhmm"] == hhmm)
        first = lambda field: F.get(F.array_compact(F.transform(mine, lambda e: e[field])), F.lit(0))
        longer = lambda kept, note: F.when(kept.isNull() | (F.length(note) > F.length(kept)), note).otherwise(kept)
        notes = F.array_compact(F.transform(mine, lambda e: e["note"]))
        return F.struct(
            hhmm.alias("hhmm"), first("percent").alias("percent_available"), first("departed").alias("departed_hhmm"),
            F.aggregate(notes, F.lit(None).cast("string"), longer).alias("status_text"),
        )

    named = cut.withColumn("_said", said).withColumn("_hhmm", F.array_distinct(F.transform("_said", lambda e: e["hhmm"])))
    return named.select("page_id", "terminal", F.explode(F.transform("_hhmm", merged)).alias("row")).select("page_id", "terminal", "row.*")


def fetch_status(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """How each collected page is classified, with raw text kept only for diagnosis."""
    recognised = rows.select("page_id").distinct().withColumn("_rows", F.lit(True))
    text = visible_text(F.col("html"))
    judged = pages.join(recognised, "page_id", "left").withColumn("_text", text)
    status = (
        F.when(F.coalesce(F.length("html"), F.lit(0)) == 0, "error")
        .when(F.col("_rows"), "ok")
        .when(~publishes_departures(F.col("_text")), "not_published")
        .otherwise("unparsed")
    )
    return judged.withColumn("fetch_status", status).select(
        "page_id", "terminal", "fetch_status",
        F.when(F.col("fetch_status") == "unparsed", F.col("_text")).alias("raw"),
    )


# The tracker's row, cell and speed markup.
ROW = r"(?is)<tr>(.*?)</tr>"
CELL = r"(?is)<td(?![^>]*colspan)[^>]*>(.*?)</td>"
SPEED_OR_BOLD = r"(?i)Speed:\s*<b>\s*[\d.]+\s*knots?|:\s*<b>[^<]+</b>|<b>[^<]+</b>"
FEED_CLOCK = r"(?i)^(\d{1,2}):(\d{2})\s*([ap])\.?m\.?$"


def _plain(cell: Column) -> Column:
    return _one_space(F.replace(decode_references(F.regexp_replace(cell, r"<[^>]+>", " ")), F.lit("\xa0"), F.lit(" ")))


def _feed_clock(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, FEED_CLOCK, i)
    return F.when(part(1) != "", clock_to_24h(part(1), part(2), F.concat(part(3), F.lit("m"))))


def tracker_rows(pages: DataFrame) -> DataFrame:
    """Vessel rows of tracker pages: a table row of exactly four plain cells is a vessel.

    A speed in the hover script belongs to the nearest bold text before it that no label
    introduces.
    """
    rows = pages.select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(ROW), F.lit(1))).alias("place", "row")
    )
    cells = rows.select(
        "page_id", "place", F.regexp_extract_all("row", F.lit(CELL), F.lit(1)).alias("cells")
    ).filter(F.size("cells") == 4)
    vessels = cells.select(
        "page_id", "place",
        *[_plain(F.col("cells")[i]).alias(n) for i, n in enumerate(("vessel", "status", "heading"))],
        _feed_clock(_plain(F.col("cells")[3])).alias("updated_hhmm"),
    ).filter((F.col("vessel") != "") & (F.lower("vessel") != "vessel"))
    tokens = pages.select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(SPEED_OR_BOLD), F.lit(0))).alias("at", "token")
    )
    name = F.when(F.lower(F.substring("token", 1, 3)) == "<b>", _plain(F.col("token")))
    walked = tokens.withColumn(
        "vessel",
        F.last(F.nullif(name, F.lit("")), ignorenulls=True).over(W.partitionBy("page_id").orderBy("at")),
    )
    knots = F.regexp_extract("token", r"(?i)^Speed:\s*<b>\s*([\d.]+)", 1)
    speeds = walked.withColumn("knots", knots.try_cast("double")).filter(
        F.col("knots").isNotNull() & F.col("vessel").isNotNull()
    ).groupBy("page_id", "vessel").agg(F.max_by("knots", "at").alias("speed_knots"))
    return vessels.join(speeds, ["page_id", "vessel"], "left")
