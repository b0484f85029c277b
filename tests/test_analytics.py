from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from tidemark.operators import analytics, lookup
from tidemark.plans import catalog

LOOP = [("o%d" % i, "customer-123", 1, a) for i, a in enumerate(["20.99", "40.99", "60.99", "80.99", "100.99"])]


def test_counts_and_totals(make_orders):
    orders = make_orders(LOOP)
    assert values(analytics.customer_stats(orders), "*") == [("customer-123", 5, Decimal("304.95"))]


def test_invalid_orders_count_and_missing_customers_do_not(make_orders):
    orders = make_orders([*LOOP, ("bad", "customer-123", 0, "10.00"), ("lost", None, 1, "5.00")])
    assert values(analytics.order_counts(orders), "*") == [("customer-123", 6)]
    assert values(analytics.total_amounts(orders), "*") == [("customer-123", Decimal("314.95"))]


def test_missing_amount_counts_as_an_order_of_zero(make_orders):
    orders = make_orders([("o1", "c1", 1, None)])
    assert values(analytics.customer_stats(orders), "*") == [("c1", 1, Decimal("0.00"))]


def test_count_and_total_share_one_shuffle(make_orders):
    assert plan_of(analytics.customer_stats(make_orders(LOOP))).count("Exchange") == 1


def test_unknown_keys_answer_zero(spark, make_orders):
    asked = spark.createDataFrame([("customer-123",), ("nobody",), ("nobody",)], "customer_id string")
    counts = analytics.order_counts(make_orders(LOOP))
    totals = analytics.total_amounts(make_orders(LOOP))
    assert values(lookup.state_get(asked, counts, "customer_id", "order_count"), "*") == [
        ("customer-123", 5),
        ("nobody", 0),
    ]
    assert values(lookup.state_get(asked, totals, "customer_id", "total_amount"), "*") == [
        ("customer-123", Decimal("304.95")),
        ("nobody", Decimal("0.00")),
    ]


TIMES = ["10:00:05", "10:00:30", "10:00:59.999", "10:01:00", "10:01:40"]


@pytest.fixture
def timed(spark):
    rows = [("customer-123", datetime.fromisoformat(f"2026-01-03 {t}")) for t in TIMES]
    rows.append((None, rows[0][1]))
    rows.append(("customer-123", None))
    return spark.createDataFrame(rows, "customer_id string, order_date timestamp")


AT = datetime(2026, 1, 3, 10, 0)
MINUTE = timedelta(minutes=1)


def test_windows(timed):
    assert values(analytics.windowed_counts(timed), "window_start", "window_end", "order_count") == [
        (AT, AT + MINUTE, 3),
        (AT + MINUTE, AT + 2 * MINUTE, 2),
    ]


def ms(at):
    return int((at - datetime(1970, 1, 1)).total_seconds() * 1000)


@pytest.mark.parametrize(
    ("start", "end", "found"),
    [
        (AT, AT + MINUTE, [3, 2]),
        (AT, AT, [3]),
        (AT + timedelta(milliseconds=1), AT + MINUTE, [2]),
        (AT + MINUTE, AT + MINUTE - timedelta(milliseconds=1), []),
        (AT - MINUTE, AT + 5 * MINUTE, [3, 2]),
    ],
)
def test_range_is_inclusive_on_window_start(timed, start, end, found):
    out = analytics.windowed_counts_for(timed, "customer-123", ms(start), ms(end))
    assert [r[1] for r in values(out, "window_start", "order_count")] == found


def test_range_defaults_to_the_last_hour(timed):
    now = F.lit(AT + timedelta(minutes=61))
    out = analytics.windowed_counts_for(timed, "customer-123", now=now)
    assert values(out, "window_start", "order_count") == [(AT + MINUTE, 2)]
    assert analytics.windowed_counts_for(timed, "customer-123").count() == 0


def test_dashboard(make_orders):
    orders = make_orders([*LOOP, ("x", "c2", 1, "0.05")])
    assert values(analytics.dashboard_totals(orders), "*") == [(6, Decimal("305.00"), 2)]
    assert values(analytics.dashboard_totals(orders.limit(0)), "*") == [(0, Decimal("0.00"), 0)]


def test_notification_stats(spark):
    rows = [("SENT",), ("SENT",), ("FAILED",), ("PENDING",), ("OTHER",), (None,)]
    df = spark.createDataFrame(rows, "status string")
    assert values(analytics.notification_stats(df), "*") == [(6, 2, 1, 1)]
    assert values(analytics.count_by_status(df, "SENT"), "*") == [(2,)]
    assert values(analytics.count_by_status(df, "NONE"), "*") == [(0,)]


def test_batch_ids(spark):
    rows = [(f"o{p}{i}", p, i) for p in (0, 1) for i in (4, 3, 0, 1, 2)]
    df = spark.createDataFrame(rows, "order_id string, partition int, offset bigint")
    assert values(analytics.batch_ids(df, batch_rows=3), "*") == [
        (0, 0, "o00, o01, o02"),
        (0, 1, "o03, o04"),
        (1, 0, "o10, o11, o12"),
        (1, 1, "o13, o14"),
    ]


def test_map_pages_hold_every_key_once(make_orders):
    orders = make_orders([(f"o{i}", f"c{i % 50}", 1, "1.00") for i in range(100)])
    pages = analytics.as_map(analytics.order_counts(orders), "customer_id", "order_count", pages=4)
    found = [entry for row in pages.collect() for entry in row["entries"].items()]
    assert sorted(found) == sorted((f"c{i}", 2) for i in range(50))
    assert pages.count() <= 4


def test_lookups(spark):
    df = spark.createDataFrame(
        [("o1", "c1", "SENT", "batch"), ("o2", "c1", "FAILED", "batch"), ("o3", "c2", "SENT", None)],
        "order_id string, customer_id string, status string, consumer_method string",
    )
    assert values(lookup.by_order(df, "o2"), "order_id") == [("o2",)]
    assert values(lookup.by_order(df, ["o1", "o3", "o9"]), "order_id") == [("o1",), ("o3",)]
    ids = spark.createDataFrame([("o3",), ("o3",), ("o9",)], "order_id string")
    assert values(lookup.by_order(df, ids), "order_id") == [("o3",)]
    assert values(lookup.by_customer(df, "c1"), "order_id") == [("o1",), ("o2",)]
    assert values(lookup.by_status(df, "SENT"), "order_id") == [("o1",), ("o3",)]
    assert values(lookup.by_method(df, "batch"), "order_id") == [("o1",), ("o2",)]
    assert lookup.by_key(df, "order_id", "nothing").count() == 0


def test_lookup_reaches_the_scan(spark, make_orders, tmp_path):
    path = str(tmp_path / "t")
    make_orders(LOOP).write.parquet(path)
    assert "EqualTo(order_id,o2)" in plan_of(lookup.by_order(spark.read.parquet(path), "o2"))


def test_batches_leave_records_without_a_place_out(spark):
    rows = [(f"o{i}", 0, i) for i in range(25)] + [(f"n{i}", 0, None) for i in range(50)] + [("p", None, 1)]
    df = spark.createDataFrame(rows, "order_id string, partition int, offset bigint")
    out = analytics.batch_ids(df, batch_rows=10)
    assert out.count() == 3
    listed = sum(len(r.ids.split(", ")) for r in out.collect())
    assert listed + analytics.batch_rejects(df).count() == len(rows)


def test_pages_of_maps_stay_bounded(spark, monkeypatch):
    """The number of pages follows the number of customers."""
    asked, as_map = [], analytics.as_map
    monkeypatch.setattr(
        analytics, "as_map", lambda df, key, value, pages: asked.append(pages) or as_map(df, key, value, pages)
    )
    monkeypatch.setattr(catalog, "PAGE_KEYS", 3)
    found = catalog.QUERIES["order_counts_as_maps"](spark, "/root/testdata/sf0.001")
    wanted = catalog.QUERIES["customer_order_counts"](spark, "/root/testdata/sf0.001")
    assert values(found, *sorted(wanted.columns)) == values(wanted, *sorted(wanted.columns))
    assert asked == [-(-wanted.count() // 3)]
