from __future__ import annotations

import json
from datetime import datetime
from decimal import Decimal

import pytest
from conftest import PLACED, plan_of, values
from pyspark.sql import functions as F

from tidemark import fixed, schemas
from tidemark.functions import headers as hdr
from tidemark.operators import delivery
from tidemark.sinks import writers
from tidemark.sources import records

GOOD = '{"orderId":"o1","customerId":"c1","productId":"p","quantity":2,"totalAmount":150.00,"orderDate":"2026-01-03T10:00:05.123456"}'


def as_records(spark, texts):
    rows = [(f"k{i}", t, "orders", i % 3, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset bigint")


def test_decode_reads_camel_case_and_keeps_metadata(spark):
    rows = values(records.decode(as_records(spark, [GOOD]), schemas.ORDER_PLACED), "*")
    assert rows == [
        (
            "o1", "c1", "p", 2, Decimal("150.00"), datetime(2026, 1, 3, 10, 0, 5, 123456), None,
            "k0", "orders", 0, 0,
        )
    ]


def test_decode_takes_numbers_as_ids_and_extra_precision(spark):
    text = '{"orderId":12,"customerId":7,"orderDate":"2026-01-03T10:00:05.123456789","more":true}'
    out = records.decode(as_records(spark, [text]), schemas.ORDER_PLACED)
    assert values(out, "order_id", "customer_id", "order_date", "quantity") == [
        ("12", "7", datetime(2026, 1, 3, 10, 0, 5, 123456), None)
    ]


BAD = [None, "", "  ", "null", "[]", '{"orderId":"o2"', '{"orderId":"o3","quantity":"many"}']


def test_every_record_is_decoded_or_rejected(spark):
    source = as_records(spark, [GOOD, *BAD])
    assert values(records.decode(source, schemas.ORDER_PLACED), "order_id") == [("o1",)]
    rejects = records.decode_rejects(source, schemas.ORDER_PLACED)
    assert values(rejects, "key", "reject_reason") == [
        ("k1", "empty value"),
        ("k2", "empty value"),
        ("k3", "empty value"),
        ("k4", "not a valid event"),
        ("k5", "not a valid event"),
        ("k6", "not a valid event"),
        ("k7", "not a valid event"),
    ]


def test_decode_can_fail_instead(spark):
    source = as_records(spark, [GOOD, '{"orderId":'])
    for value in (None, "", "  ", "null", '{"orderId":', "[]", '{"orderId": "a", "quantity": "x"}', "{}", GOOD):
        one = as_records(spark, [GOOD, value])
        rejected = records.decode_rejects(one, schemas.ORDER_PLACED).count()
        failing = records.decode(one, schemas.ORDER_PLACED, on_error="fail")
        if rejected:
            with pytest.raises(Exception, match="not a valid event"):
                failing.collect()
            with pytest.raises(Exception, match="not a valid event"):
                failing.select("order_id").write.format("noop").mode("overwrite").save()
        else:
            assert failing.count() == 2
    assert records.decode(as_records(spark, [GOOD]), schemas.ORDER_PLACED, "fail").count() == 1
    with pytest.raises(ValueError):
        records.decode(source, schemas.ORDER_PLACED, on_error="ignore")


def test_json_is_parsed_once(spark, tmp_path):
    path = str(tmp_path / "r")
    as_records(spark, [GOOD, *BAD]).write.parquet(path)
    out = records.decode(spark.read.parquet(path), schemas.ORDER_PLACED)
    plan = plan_of(out)
    assert plan.count("from_json(") == 1


def test_encode_then_decode_is_identity(make_orders):
    orders = make_orders([("o1", "c1", 2, "150.00"), ("o2", None, None, None)])
    sent = writers.to_records(orders, fixed.TOPIC_ORDERS)
    assert values(sent, "key", "topic") == [("o1", "orders"), ("o2", "orders")]
    back = records.decode(sent, schemas.ORDER_PLACED).select(orders.columns)
    assert values(back, "*") == values(orders, "*")
    text = sent.filter("key = 'o1'").first()["value"]
    assert json.loads(text)["orderDate"] == "2026-01-03T10:00:05.000000"
    assert '"totalAmount":150.00' in text


def test_headers(spark, make_orders):
    order_id = F.col("order_id")
    sent = make_orders([("o1", "c1", 1, "1.00")]).transform(
        lambda df: hdr.with_headers(df, hdr.order_headers(order_id, F.lit(1700000000000)))
    )
    stamped = hdr.stamp(sent, F.lit(42))
    row = stamped.select(hdr.as_map().alias("m")).first()["m"]
    assert row == {
        "correlation-id": "o1",
        "source": "order-service",
        "timestamp": "1700000000000",
        "event-version": "1.0",
        "intercepted-at": "42",
    }
    message = "Order confirmation email sent (with headers - correlation-id: %s)"
    assert stamped.select(delivery.header_message()).first()[0] == message % "o1"
    bare = make_orders([("o2", "c1", 1, "1.00")]).withColumn(
        "headers", F.lit(None).cast(schemas.HEADERS)
    )
    read = records.header(bare, "correlation-id")
    assert read.first()["correlation_id"] is None
    assert bare.select(delivery.header_message()).first()[0] == message % "N/A"
    assert records.header_rows(bare, "order_id").count() == 0
    assert hdr.stamp(bare, F.lit(1)).select(hdr.value_of("intercepted-at")).first()[0] == "1"


def test_last_header_of_a_name_counts(make_orders):
    twice = make_orders([("o1", "c1", 1, "1.00")]).transform(
        lambda df: hdr.with_headers(df, {"a": F.lit("1"), "b": F.lit("x")})
    )
    twice = hdr.with_headers(twice, {"a": F.lit("2")})
    assert twice.select(hdr.value_of("a")).first()[0] == "2"
    assert records.headers_map(twice).first()["headers_map"] == {"a": "2", "b": "x"}
    assert values(records.header_rows(twice, "order_id"), "*") == [("o1", "a", "2"), ("o1", "b", "x")]


def test_kafka_options():
    assert records.kafka_options("h:1") == {
        "kafka.bootstrap.servers": "h:1",
        "startingOffsets": "earliest",
        "includeHeaders": "true",
        "subscribe": "orders",
    }
    chosen = records.kafka_options(
        "h:1", partitions=[3, 1], max_per_trigger=100, committed_only=True, starting="latest"
    )
    assert chosen["assign"] == '{"orders": [1, 3]}' and "subscribe" not in chosen
    assert chosen["maxOffsetsPerTrigger"] == "100"
    assert chosen["kafka.isolation.level"] == "read_committed"
    assert chosen["startingOffsets"] == "latest"


def test_partition_files_are_pruned(spark, make_orders, tmp_path):
    path = str(tmp_path / "topic")
    sent = writers.to_records(make_orders([(f"o{i}", "c", 1, "1.00") for i in range(9)]), "orders")
    placed = writers.to_partition(sent, F.substring("key", 2, 1).cast("int") % 3)
    placed = placed.withColumn("offset", F.lit(0).cast("bigint"))
    writers.write_records(placed, path, layout=("topic", "partition"))
    some = records.read_files(spark, path, partitions=[1])
    assert values(some, "key", "partition") == [("o1", 1), ("o4", 1), ("o7", 1)]
    plan = plan_of(some)
    assert "PartitionFilters: [isnotnull(partition" in plan


def test_committed_only(spark):
    events = spark.createDataFrame([("a", 1), ("b", 2)], "transaction_id string, n int")
    commits = spark.createDataFrame([("b",), ("b",), ("z",)], "transaction_id string")
    assert values(records.committed_only(events, commits), "n") == [(2,)]


def test_tables(spark, make_orders, tmp_path):
    path = str(tmp_path / "table")
    rows = make_orders([("o1", "c1", 1, "1.00"), ("o2", "c1", 1, "2.00")]).withColumns(
        {"kafka_partition": F.lit(1), "msg_offset": F.col("quantity").cast("bigint") + 4}
    )
    stored = writers.table_rows(rows, now=F.lit(PLACED))
    assert values(stored, "id", "created_at")[0] == (2**42 + 5, PLACED)
    writers.append_rows(stored, path, 7, "one")
    writers.append_rows(stored, path, 7, "one")  # a retry
    writers.append_rows(stored, path, 8, "one")
    assert records.read_table(spark, path).groupBy("batch_id").count().count() == 2
    assert records.read_table(spark, path).count() == 4
    writers.append_rows(stored, path, 7, "another/one")  # touches nothing of the first
    writers.append_rows(stored, path, 7, "another/one")
    assert records.read_table(spark, path).count() == 6


def test_default_value(spark):
    df = spark.createDataFrame([("a", None), ("b", "CANCELLED")], "id string, status string")
    assert values(writers.with_default(df, "status", "PENDING"), "*") == [
        ("a", "PENDING"),
        ("b", "CANCELLED"),
    ]
    assert values(writers.with_default(df.select("id"), "status", "PENDING"), "status") == [
        ("PENDING",),
        ("PENDING",),
    ]
