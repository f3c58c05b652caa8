"""The bound tables reach the branches the queries are there to check."""

from __future__ import annotations

import duckdb
import pytest

import checks.all_queries  # noqa: F401  registers the shapes
from checks.views import check_sql
from tidewait.params import OUTCOMES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ask():
    con = duckdb.connect()
    for table in ("events", "orders", "lineitem", "documents", "pages"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return lambda text: con.execute(check_sql(text)).fetchall()


def test_every_method_and_outcome_of_the_merge_occurs(ask):
    found = ask("select outcome, case when method like 'frames%' then 'frames' else method end as m, count(*) from o_final group by 1,2")
    assert {m for _, m, _ in found} == {"frames", "report", "deck_space"}
    assert {o for o, _, _ in found} >= set(OUTCOMES) - {"unknown"}
    assert {o for o, m, _ in found if m == "report"} >= {"boarded", "filled", "waited_1", "waited_2plus"}


def test_both_limits_of_reading_bind(ask):
    import __spark_entry__ as entry

    days = ask(f"select count(*) filter (day_full), count(*) filter (month_spent), count(*) filter (not day_full and not month_spent) from ({entry.oracle_sql()['str07_budget_stop']})")
    assert all(n > 0 for n in days[0])


def test_every_problem_of_collection_occurs(ask):
    import __spark_entry__ as entry

    text = " ".join(r[0] for r in ask(f"select problems from ({entry.oracle_sql()['agg19_capture_health']})"))
    for words in ("no cameras", "captures at", "frames wait", "near the budget", "no marine forecast", "the marine forecast is stale", "the shore forecast is stale", "records for"):
        assert words in text, words


def test_every_image_type_and_every_reject_occurs(ask):
    import __spark_entry__ as entry

    kinds = ask(f"select right(path, 4), width is null, count(*) from ({entry.oracle_sql()['src04_frame_ingest']}) where path is not null group by 1,2")
    assert {(k.lstrip("."), cut) for k, cut, _ in kinds} == {(k, cut) for k in ("jpg", "png", "gif", "webp") for cut in (True, False)}
    reasons = {r[0] for r in ask(f"select distinct reason from ({entry.oracle_sql()['src03_import_outcomes']})")}
    assert reasons == {None, "wrong number of columns", "bad date", "unknown terminal", "unknown outcome", "bad time"}
