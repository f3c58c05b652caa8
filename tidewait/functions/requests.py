"""Request-log classification: who is a machine, and what the rest read with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Paths that are traffic and not visits.
IGNORED_PREFIXES = (
    "/healthz", "/static/", "/favicon.ico", "/manifest.webmanifest", "/api/docs", "/openapi.json",
)
# Agents that are machines.
BOT_AGENTS = (
    r"(?i)bot\b|bot/|crawl|spider|slurp|scrape|monitor|uptime|preview|fetcher|headless|"
    r"curl/|wget|python-requests|httpx|okhttp|axios|go-http|java/|libwww|lighthouse|"
    r"facebookexternalhit|whatsapp|telegram|discord|slack|twitter|linkedin|pinterest|"
    r"embedly|quora link preview|vercel|render"
)
# Browsers, operating systems and devices; the first match wins.
BROWSERS = (
    ("Microsoft Edge", r"(?i)Edg(?:e|A|iOS)?/"),
    ("Opera", r"(?i)OPR/|Opera"),
    ("Samsung Internet", r"(?i)SamsungBrowser"),
    ("Firefox", r"(?i)Firefox/|FxiOS/"),
    ("Chrome", r"(?i)CriOS/|Chrome/|Chromium/"),
    ("Safari", r"Safari/"),
    ("Internet Explorer", r"MSIE |Trident/"),
)
SYSTEMS = (
    ("iOS", r"(?i)iPhone|iPad|iPod|iOS|CPU OS "),
    ("Android", r"(?i)Android"),
    ("Windows", r"Windows"),
    ("Chrome OS", r"CrOS"),
    ("Mac OS X", r"Macintosh|Mac OS X"),
    ("Linux", r"Linux|X11"),
)
DEVICES = (
    ("Tablet", r"(?i)iPad|Tablet|PlayBook|Silk|(?=.*\bAndroid\b)(?!.*\bMobile\b)"),
    ("Mobile", r"(?i)Mobi|iPhone|iPod|Android|Windows Phone|BlackBerry"),
    ("Desktop", r"(?i)Windows NT|Macintosh|X11|CrOS|Linux"),
)
CAMPAIGN = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term")


def first_match(table, text: Column) -> Column:
    chain = F.when(text.rlike(table[0][1]), table[0][0])
    for name, pattern in table[1:]:
        chain = chain.when(text.rlike(pattern), name)
    return chain.otherwise("unknown")


def is_bot(agent: Column) -> Column:
    """No agent at all is a script, never a browser."""
    return F.coalesce((agent == "") | agent.rlike(BOT_AGENTS), F.lit(True))


def classify_requests(log: DataFrame) -> DataFrame:
    """Visits only, from log(url, agent, ...), with browser, system, device and campaign."""
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    ignored = F.lit(False)
    for prefix in IGNORED_PREFIXES:
        ignored = ignored | F.col("path").startswith(prefix)
    visits = log.withColumn("path", path).filter(~ignored & ~is_bot(F.col("agent")))
    agent = F.col("agent")
    return visits.withColumns(
        {
            "host": F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")),
            "browser": first_match(BROWSERS, agent),
            "visitor_os": first_match(SYSTEMS, agent),
            "device": first_match(DEVICES, agent),
            **{
                c: F.nullif(F.try_parse_url("url", F.lit("QUERY"), F.lit(c)), F.lit(""))
                for c in CAMPAIGN
            },
        }
    )
