"""The catalog's queries as SQL over the stored tables, for a second engine to check."""

from __future__ import annotations

# Common tables; each query lists the ones it needs.
_CTES = {
    "oe": """
        SELECT CAST(event_id AS VARCHAR) AS order_id,
               'customer-' || CAST(user_id AS VARCHAR) AS customer_id,
               'product-' || CAST(k AS VARCHAR) AS product_id,
               CAST(k % 6 AS INTEGER) AS quantity,
               CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(38,2)) AS total_amount,
               ts AS order_date,
               CAST(event_id % 3 AS INTEGER) AS "partition",
               event_id // 3 AS "offset",
               event_id, event_type, k
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "oe_replayed": """
        SELECT * FROM oe UNION ALL
        SELECT * REPLACE ("offset" + 1000000000000 AS "offset") FROM oe WHERE event_id % 7 = 0""",
    "oe_first": """
        SELECT * EXCLUDE (rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY "partition", "offset") AS rn
          FROM oe_replayed) WHERE rn = 1""",
    "enriched": """
        SELECT *, CASE WHEN total_amount >= 100 THEN 'HIGH_VALUE' ELSE 'REGULAR' END AS order_category,
               'PROCESSED' AS processing_status FROM oe""",
    "valid": """
        SELECT * FROM enriched WHERE quantity IS NOT NULL AND quantity > 0
          AND total_amount IS NOT NULL AND total_amount > 0""",
    "headers": """
        SELECT *, CAST(epoch_ms(date_trunc('second', order_date)) AS VARCHAR) AS sent,
               event_id % 5 AS sender FROM oe""",
    "methods": """
        SELECT * FROM (VALUES
          (0, 'idempotent-order-consumer', 'payment-service-order-group', ''),
          (1, 'auto-commit', 'notification-service-group', ''),
          (2, 'manual-commit', 'notification-service-manual-group', ' (manual commit)'),
          (3, 'batch', 'notification-service-batch-group', ' (batch)'),
          (4, 'specific-partition', 'notification-service-specific-partition-group', ' (specific partition)'),
          (5, 'with-headers', 'notification-service-headers-group', ' (with headers - correlation-id: '),
          (6, 'all-headers', 'notification-service-all-headers-group', ' (all headers)'),
          (7, 'concurrent', 'notification-service-concurrent-group', ' (concurrent)'),
          (8, 'idempotent', 'notification-service-idempotent-group', ' (idempotent)'))
        AS m(number, consumer_method, consumer_group, suffix)""",
    "notified": """
        SELECT (CAST(number AS BIGINT) * 8 * 16384 + "partition") * 4398046511104 + "offset" AS id,
               order_id, customer_id, 'EMAIL' AS notification_type,
               CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'PENDING' ELSE 'SENT' END AS status,
               'Order confirmation email sent' || suffix || CASE WHEN number = 5
                 THEN CASE WHEN event_id % 5 = 0 THEN 'N/A' ELSE order_id END || ')' ELSE '' END AS message,
               CASE WHEN number NOT IN (6, 8) THEN "partition" END AS kafka_partition,
               CASE WHEN number NOT IN (6, 7) THEN "offset" END AS msg_offset,
               consumer_group, consumer_method
        FROM oe_first JOIN methods ON number = event_id % 9""",
    "windowed": """
        SELECT customer_id, date_trunc('minute', order_date) AS window_start,
               date_trunc('minute', order_date) + INTERVAL 1 MINUTE AS window_end,
               count(*) AS order_count
        FROM oe GROUP BY ALL""",
    "judged": """
        SELECT *, max(order_date) OVER (PARTITION BY "partition" ORDER BY arrival, event_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stream_time
        FROM (SELECT *, event_id + CASE WHEN event_id % 7 = 0 THEN 10 ELSE 0 END AS arrival FROM oe)""",
    "totals": """
        SELECT customer_id, count(*) AS order_count,
               CAST(sum(total_amount) AS DECIMAL(38,2)) AS total_amount
        FROM oe GROUP BY customer_id""",
    "pr": """
        SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
               'customer-' || CAST(o_custkey AS VARCHAR) AS customer_id,
               'product-123' AS product_id, 1 AS quantity,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,2)) AS amount,
               o_orderdate AS order_date, o_orderstatus AS order_status,
               CAST(o_orderkey % 3 AS INTEGER) AS "partition", o_orderkey // 3 AS "offset", o_orderkey,
               sha256('payment|' || CAST(o_orderkey AS VARCHAR)) AS payment_id,
               sha256('transaction|' || CAST(o_orderkey AS VARCHAR)) AS transaction_id
        FROM orders""",
    "signed": """
        SELECT * REPLACE (CASE WHEN o_orderkey % 50 = 0 THEN -amount ELSE amount END AS amount) FROM pr""",
    "paid": """
        SELECT * FROM pr WHERE order_status <> 'O'""",
    "placed": """
        SELECT order_id FROM pr WHERE order_status = 'O'
        UNION ALL SELECT order_id FROM paid WHERE amount <= 400000""",
    "saga": """
        SELECT *, CASE WHEN amount > 400000 THEN 'PAYMENT_FAILED'
                       WHEN amount > 200000 THEN 'INVENTORY_UNAVAILABLE' ELSE 'CONFIRMED' END AS outcome,
               sha256('reservation|' || order_id) AS reservation_id,
               CAST(trunc(amount) AS INTEGER) AS stock_quantity
        FROM pr""",
    "log": """
        SELECT 'orders' AS topic, order_id, 1 AS seq, 'OrderPlaced' AS event_type, '1.0' AS event_version,
               'order-service' AS source, transaction_id, order_date AS "timestamp" FROM saga
        UNION ALL
        SELECT 'payments', order_id, 2, 'PaymentProcessed', '1.0', 'payment-service', transaction_id, order_date FROM saga
        UNION ALL
        SELECT 'inventory', order_id, 3, 'InventoryReserved', '1.0', 'inventory-service', transaction_id, order_date
        FROM saga WHERE outcome <> 'PAYMENT_FAILED'
        UNION ALL
        SELECT 'payments', order_id, 4, 'PaymentRefunded', '1.0', 'payment-service', transaction_id, order_date
        FROM saga WHERE outcome = 'INVENTORY_UNAVAILABLE'
        UNION ALL
        SELECT 'orders', order_id, 5, 'OrderCancelled', '1.0', 'order-service', transaction_id, order_date
        FROM saga WHERE outcome = 'INVENTORY_UNAVAILABLE'""",
    "disturbed": """
        SELECT transaction_id, event_type, CASE WHEN CAST(order_id AS BIGINT) % 5 = 0 AND seq = 2 THEN 3
            WHEN CAST(order_id AS BIGINT) % 5 = 0 AND seq = 3 THEN 2 ELSE seq END AS seq FROM log
        UNION ALL SELECT transaction_id, event_type, 6 FROM log WHERE seq = 2 AND CAST(order_id AS BIGINT) % 7 = 0
        UNION ALL SELECT transaction_id, 'other', CASE WHEN CAST(order_id AS BIGINT) % 2 = 0 THEN 0 ELSE 7 END
        FROM log WHERE seq = 2 AND CAST(order_id AS BIGINT) % 11 = 0""",
    "attempts": """
        SELECT *, CAST(k % 4 + 1 AS INTEGER) AS attempt, event_type AS failure_class,
               k % 4 < 2 AND event_type IN ('error', 'view') AS again FROM oe""",
}
_NEEDS = {
    "oe_replayed": ["oe"],
    "oe_first": ["oe_replayed"],
    "enriched": ["oe"],
    "valid": ["enriched"],
    "headers": ["oe"],
    "notified": ["oe_first", "methods"],
    "disturbed": ["log"],
    "attempts": ["oe"],
    "windowed": ["oe"],
    "judged": ["oe"],
    "totals": ["oe"],
    "signed": ["pr"],
    "paid": ["pr"],
    "placed": ["paid"],
    "saga": ["pr"],
    "log": ["saga"],
}


def _with(names: list[str], body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    return "WITH " + ", ".join(f"{n} AS ({_CTES[n]})" for n in ordered) + "\n" + body


_ORDER = "order_id, customer_id, product_id, quantity, total_amount, order_date"
_ENRICHED = _ORDER + ", order_category, processing_status"
_SPOT = '"partition", "offset"'
# How JSON shows a time: UTC, microseconds.
_JSON_TIME = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"
_CONSISTENCY = """
    SELECT order_id, has_order AND has_payment AS is_consistent, has_order, has_payment,
           CASE WHEN has_order AND has_payment THEN 'Order and payment both exist - consistent state'
                WHEN has_payment THEN 'INCONSISTENCY: Payment exists but order does not (non-transactional issue!)'
                WHEN has_order THEN 'INCONSISTENCY: Order exists but payment does not'
                ELSE 'Neither order nor payment found' END AS message
    FROM ({ids})"""

_BODIES: dict[str, tuple[list[str], str]] = {
    "orders_decode": (["oe"], f"SELECT {_ORDER}, {_SPOT} FROM oe"),
    "orders_decode_rejected": (
        ["oe"],
        f"SELECT order_id AS key, {_SPOT}, 'not a valid event' AS reject_reason FROM oe WHERE event_type = 'error'",
    ),
    "orders_encode": (
        ["oe"],
        """SELECT order_id AS key, 'orders' AS topic, "partition", order_id, customer_id, product_id,
                  CAST(quantity AS VARCHAR) AS quantity, total_amount,
                  {time} AS order_date FROM oe""".replace("{time}", _JSON_TIME.format("order_date")),
    ),
    "payments_encode": (
        ["pr"],
        """SELECT payment_id AS key, 'payments' AS topic, payment_id, order_id, customer_id,
                  amount, 'PROCESSED' AS status, {time} AS processed_at, transaction_id
           FROM pr WHERE amount <= 400000""".replace("{time}", _JSON_TIME.format("order_date")),
    ),
    "orders_from_partition": (["oe"], f'SELECT {_ORDER}, {_SPOT} FROM oe WHERE "partition" = 1'),
    "orders_to_partition": (
        ["oe"],
        'SELECT order_id, CAST(k % 4 AS INTEGER) AS "partition", "offset" FROM oe',
    ),
    "order_headers": (
        ["headers"],
        """SELECT order_id, CASE WHEN sender <> 0 THEN order_id END AS correlation_id,
                  CASE WHEN sender <> 0 THEN 'order-service' END AS source,
                  CASE WHEN sender > 1 THEN '1.0' END AS event_version,
                  CASE WHEN sender = 1 THEN 'OrderPlacedEvent' END AS message_type,
                  CAST(CAST(sent AS BIGINT) + 1 AS VARCHAR) AS intercepted_at,
                  'Order confirmation email sent (with headers - correlation-id: '
                  || CASE WHEN sender <> 0 THEN order_id ELSE 'N/A' END || ')' AS message
           FROM headers""",
    ),
    "order_headers_exploded": (
        ["headers"],
        """SELECT order_id, 'correlation-id' AS header, order_id AS value FROM headers WHERE sender <> 0
           UNION ALL SELECT order_id, 'source', 'order-service' FROM headers WHERE sender <> 0
           UNION ALL SELECT order_id, 'timestamp', sent FROM headers WHERE sender > 1
           UNION ALL SELECT order_id, 'event-version', '1.0' FROM headers WHERE sender > 1
           UNION ALL SELECT order_id, 'message-type', 'OrderPlacedEvent' FROM headers WHERE sender = 1""",
    ),
    "orders_event_timestamp": (
        ["oe"],
        "SELECT order_id, epoch_ms(date_trunc('second', order_date)) AS event_ms FROM oe",
    ),
    "orders_enriched": (["enriched"], f"SELECT {_ENRICHED} FROM enriched"),
    "orders_valid": (["valid"], f"SELECT {_ENRICHED} FROM valid"),
    "orders_rejected": (
        ["oe"],
        """SELECT order_id, quantity, total_amount,
                  CASE WHEN quantity IS NULL THEN 'quantity missing' WHEN quantity <= 0 THEN 'quantity not positive'
                       WHEN total_amount IS NULL THEN 'amount missing' ELSE 'amount not positive' END AS reject_reason
           FROM oe WHERE quantity IS NULL OR quantity <= 0 OR total_amount IS NULL OR total_amount <= 0""",
    ),
    "orders_high_value": (["valid"], f"SELECT {_ENRICHED} FROM valid WHERE order_category = 'HIGH_VALUE'"),
    "orders_regular": (["valid"], f"SELECT {_ENRICHED} FROM valid WHERE order_category = 'REGULAR'"),
    "orders_routed": (
        ["valid"],
        f"""SELECT CASE WHEN order_category = 'HIGH_VALUE' THEN 'high-value-orders' ELSE 'processed-orders' END AS topic,
                   {_ENRICHED} FROM valid""",
    ),
    "orders_from_requests": (
        ["pr"],
        """SELECT sha256('order|' || order_id) AS order_id, customer_id, product_id, quantity, amount,
                  transaction_id FROM pr""",
    ),
    "notifications": (["notified"], "SELECT * FROM notified"),
    "payments_table": (
        ["pr"],
        """SELECT (CAST(9 AS BIGINT) * 8 + 1) * 16384 * 4398046511104 + "partition" * 4398046511104 + "offset" AS id,
                  payment_id, order_id, customer_id, amount, 'PROCESSED' AS status, order_date AS processed_at,
                  transaction_id, "partition" AS kafka_partition, "offset" AS kafka_offset,
                  'payment-service-payment-group' AS consumer_group, order_date AS created_at
           FROM pr WHERE amount >= 0""",
    ),
    "find_by_order": (
        ["notified", "pr"],
        "SELECT * FROM notified WHERE order_id IN (SELECT order_id FROM pr)",
    ),
    "find_by_customer": (["notified"], "SELECT * FROM notified WHERE customer_id = 'customer-7'"),
    "find_by_status": (["notified"], "SELECT * FROM notified WHERE status = 'PENDING'"),
    "find_by_method": (["notified"], "SELECT * FROM notified WHERE consumer_method = 'batch'"),
    "find_by_payment": (
        ["saga"],
        """SELECT payment_id, order_id, customer_id, amount,
                  CASE outcome WHEN 'PAYMENT_FAILED' THEN 'FAILED' WHEN 'CONFIRMED' THEN 'SUCCESS'
                       ELSE 'REFUNDED' END AS status, transaction_id
           FROM saga WHERE payment_id = sha256('payment|7')""",
    ),
    "find_payment_by_order": (
        ["saga"],
        """SELECT order_id, payment_id, amount, CASE outcome WHEN 'PAYMENT_FAILED' THEN 'FAILED'
                  WHEN 'CONFIRMED' THEN 'SUCCESS' ELSE 'REFUNDED' END AS status
           FROM saga WHERE order_status = 'P'""",
    ),
    "find_reservation_by_order": (
        ["saga"],
        """SELECT order_id, reservation_id, stock_quantity AS quantity,
                  CASE outcome WHEN 'CONFIRMED' THEN 'RESERVED' ELSE 'UNAVAILABLE' END AS status
           FROM saga WHERE order_status = 'P' AND outcome <> 'PAYMENT_FAILED'""",
    ),
    "find_order": (
        ["saga"],
        """SELECT order_id, customer_id, CASE outcome WHEN 'CONFIRMED' THEN 'PENDING' ELSE 'CANCELLED' END AS status
           FROM saga WHERE order_id IN ('7', '12', 'no such order')""",
    ),
    "order_counts_as_maps": (["totals"], "SELECT customer_id, order_count FROM totals"),
    "customer_order_counts": (["totals"], "SELECT customer_id, order_count FROM totals"),
    "customer_total_amounts": (["totals"], "SELECT customer_id, total_amount FROM totals"),
    "customer_windowed_counts": (["windowed"], "SELECT * FROM windowed"),
    "windowed_counts_range": (
        ["windowed"],
        """SELECT * FROM windowed WHERE customer_id = 'customer-7'
           AND window_start BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'""",
    ),
    "late_events": (
        ["judged"],
        f"""SELECT {_ORDER}, arrival, stream_time FROM judged
            WHERE date_trunc('minute', order_date) + INTERVAL 70 SECOND <= stream_time""",
    ),
    "windowed_counts_with_grace": (
        ["judged"],
        """SELECT customer_id, date_trunc('minute', order_date) AS window_start,
                  date_trunc('minute', order_date) + INTERVAL 1 MINUTE AS window_end, count(*) AS order_count
           FROM judged WHERE date_trunc('minute', order_date) + INTERVAL 70 SECOND > stream_time GROUP BY ALL""",
    ),
    "count_for_customers": (
        ["totals"],
        """SELECT 'customer-' || CAST(c_custkey AS VARCHAR) AS customer_id, coalesce(order_count, 0) AS order_count
           FROM customer LEFT JOIN totals ON customer_id = 'customer-' || CAST(c_custkey AS VARCHAR)""",
    ),
    "total_for_customers": (
        ["totals"],
        """SELECT 'customer-' || CAST(c_custkey AS VARCHAR) AS customer_id,
                  CAST(coalesce(total_amount, 0) AS DECIMAL(38,2)) AS total_amount
           FROM customer LEFT JOIN totals ON customer_id = 'customer-' || CAST(c_custkey AS VARCHAR)""",
    ),
    "dashboard_totals": (
        ["totals"],
        """SELECT CAST(coalesce(sum(order_count), 0) AS BIGINT) AS total_orders,
                  CAST(coalesce(sum(total_amount), 0) AS DECIMAL(38,2)) AS total_revenue,
                  count(*) AS customer_count FROM totals""",
    ),
    "money_format": (
        ["totals"],
        """SELECT customer_id, '₹' || replace(format('{:,.2f}', CAST(total_amount AS DOUBLE)), ',', '.') AS total_text
           FROM totals""",
    ),
    "notification_stats": (
        ["notified"],
        """SELECT count(*) AS total, count(*) FILTER (status = 'SENT') AS sent,
                  count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'PENDING') AS pending
           FROM notified""",
    ),
    "count_by_status": (["notified"], "SELECT count(*) AS n FROM notified WHERE status = 'FAILED'"),
    "notification_texts": (
        ["oe"],
        """SELECT order_id, 'EMAIL' AS channel, 'Your order ' || order_id || ' for $' || CAST(total_amount AS VARCHAR)
                  || ' has been placed successfully!' AS text FROM oe
           UNION ALL SELECT order_id, 'SMS', 'Order ' || order_id || ' confirmed. Amount: $'
                  || CAST(total_amount AS VARCHAR) FROM oe
           UNION ALL SELECT order_id, 'PUSH', 'New order ' || order_id || ' placed!' FROM oe""",
    ),
    "batch_order_ids": (
        ["oe"],
        """SELECT "partition", "offset" // 10 AS batch, string_agg(order_id, ', ' ORDER BY "offset") AS ids
           FROM oe GROUP BY 1, 2""",
    ),
    "orders_first_per_key": (["oe_first"], f"SELECT {_ORDER}, {_SPOT} FROM oe_first"),
    "payments_first_per_key": (
        ["pr"],
        f"""SELECT payment_id, order_id, customer_id, amount, {_SPOT} FROM (
              SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY "partition", "offset") AS rn FROM (
                SELECT * FROM pr UNION ALL
                SELECT * REPLACE ("offset" + 1000000000000 AS "offset") FROM pr WHERE o_orderkey % 7 = 0))
            WHERE rn = 1""",
    ),
    "orders_new_only": (
        ["oe_first"],
        f"""SELECT {_ORDER}, {_SPOT} FROM oe_first WHERE order_id NOT IN (
              SELECT order_id FROM oe WHERE order_date < TIMESTAMP '2024-01-16 00:00:00')""",
    ),
    "payments_atomic": (
        ["signed"],
        "SELECT payment_id, order_id, amount FROM signed WHERE amount >= 0 AND amount <= 400000",
    ),
    "payments_non_atomic": (
        ["signed"],
        "SELECT payment_id, order_id, amount FROM signed WHERE amount >= 0",
    ),
    "payments_committed": (
        ["signed"],
        """SELECT payment_id, order_id, amount FROM signed WHERE amount >= 0 AND transaction_id IN (
             SELECT transaction_id FROM signed WHERE amount >= 0 AND amount <= 400000)""",
    ),
    "orders_published": (
        ["signed"],
        """SELECT order_id, customer_id, product_id, quantity, amount FROM signed
           WHERE amount >= 0 AND amount <= 400000""",
    ),
    "payments_refused": (
        ["signed"],
        "SELECT order_id, amount, 'Invalid amount - must be positive' AS reason FROM signed WHERE amount < 0",
    ),
    "payments_with_order": (
        ["placed"],
        """SELECT payment_id, order_id, order_id IN (SELECT order_id FROM placed) AS has_order FROM paid""",
    ),
    "order_consistency": (
        ["placed"],
        _CONSISTENCY.format(
            ids="""SELECT order_id, order_id IN (SELECT order_id FROM placed) AS has_order,
                          order_id IN (SELECT order_id FROM paid) AS has_payment
                   FROM (SELECT order_id FROM pr
                         UNION ALL SELECT 'unknown-' || CAST(c_custkey AS VARCHAR) FROM customer)"""
        ),
    ),
    "order_consistency_all": (
        ["placed"],
        _CONSISTENCY.format(
            ids="""SELECT coalesce(o.order_id, p.order_id) AS order_id, o.order_id IS NOT NULL AS has_order,
                          p.order_id IS NOT NULL AS has_payment
                   FROM placed o FULL OUTER JOIN paid p ON o.order_id = p.order_id"""
        ),
    ),
    "inconsistencies": (
        ["placed"],
        """SELECT 'PAYMENT_WITHOUT_ORDER' AS type, payment_id, order_id, customer_id,
                  'INCONSISTENCY: Payment exists but order does not (non-transactional issue!)' AS issue
           FROM paid ANTI JOIN placed USING (order_id)""",
    ),
    "inconsistency_summary": (
        ["placed"],
        """SELECT total, CASE WHEN total = 0
                  THEN 'No inconsistencies found - all payments have corresponding orders'
                  ELSE 'Found ' || CAST(total AS VARCHAR) || ' inconsistency(ies)' END AS message
           FROM (SELECT count(*) AS total FROM paid ANTI JOIN placed USING (order_id))""",
    ),
    "inconsistency_report": (
        ["placed"],
        """SELECT total, 'Found ' || CAST(total AS VARCHAR) || ' inconsistency(ies)' AS message, type, payment_id,
                  order_id, customer_id, issue FROM (
             SELECT count(*) OVER () AS total, 'PAYMENT_WITHOUT_ORDER' AS type, payment_id, order_id, customer_id,
                    'INCONSISTENCY: Payment exists but order does not (non-transactional issue!)' AS issue
             FROM paid ANTI JOIN placed USING (order_id))""",
    ),
    "retry_schedule": (
        ["attempts"],
        """SELECT order_id, attempt, CAST(CASE attempt WHEN 1 THEN 0 WHEN 2 THEN 1000 WHEN 3 THEN 2000 END AS BIGINT)
                  AS delay_ms, attempt >= 3 AS last_attempt FROM attempts""",
    ),
    "dead_letters": (
        ["attempts"],
        f"SELECT {_ORDER}, attempt, failure_class FROM attempts WHERE event_type <> 'purchase' AND NOT again",
    ),
    "failure_routes": (
        ["attempts"],
        """SELECT order_id, attempt, failure_class,
                  CASE WHEN again THEN 'orders-retry-' || CAST(attempt - 1 AS VARCHAR) ELSE 'orders-dlt' END AS topic,
                  CAST(CASE WHEN again THEN attempt + 1 END AS INTEGER) AS next_attempt,
                  CAST(CASE WHEN again THEN 1000 * attempt END AS BIGINT) AS next_delay_ms
           FROM attempts WHERE event_type <> 'purchase'""",
    ),
    "saga_orders": (
        ["saga"],
        """SELECT order_id, customer_id, product_id, quantity, amount AS total_amount,
                  CASE outcome WHEN 'CONFIRMED' THEN 'PENDING' ELSE 'CANCELLED' END AS status,
                  order_date, transaction_id FROM saga""",
    ),
    "saga_payments": (
        ["saga"],
        """SELECT payment_id, order_id, customer_id, amount,
                  CASE outcome WHEN 'PAYMENT_FAILED' THEN 'FAILED' WHEN 'CONFIRMED' THEN 'SUCCESS'
                       ELSE 'REFUNDED' END AS status, order_date AS processed_at, transaction_id FROM saga""",
    ),
    "saga_inventory": (
        ["saga"],
        """SELECT reservation_id, order_id, product_id, stock_quantity AS quantity,
                  CASE outcome WHEN 'CONFIRMED' THEN 'RESERVED' ELSE 'UNAVAILABLE' END AS status,
                  order_date AS reserved_at, transaction_id
           FROM saga WHERE outcome <> 'PAYMENT_FAILED'""",
    ),
    "saga_cancellations": (
        ["saga"],
        """SELECT order_id, 'Payment refunded' AS reason, order_date AS cancelled_at
           FROM saga WHERE outcome = 'INVENTORY_UNAVAILABLE'""",
    ),
    "saga_orders_by_step": (
        ["saga"],
        """SELECT order_id, CASE outcome WHEN 'CONFIRMED' THEN 'PENDING' ELSE 'CANCELLED' END AS status,
                  CASE outcome WHEN 'PAYMENT_FAILED' THEN 'Payment failed'
                       WHEN 'INVENTORY_UNAVAILABLE' THEN 'Payment refunded' END AS reason FROM saga""",
    ),
    "saga_emails": (
        ["saga"],
        """SELECT order_id, transaction_id, 'Your order ' || order_id
                  || ' has been confirmed and inventory reserved! TransactionId: ' || transaction_id AS text
           FROM saga WHERE outcome = 'CONFIRMED'""",
    ),
    "saga_event_log": (["log"], "SELECT * FROM log"),
    "saga_event_dispatch": (
        ["log"],
        """SELECT event_type, order_id,
                  CASE WHEN event_type LIKE 'Payment%' THEN payment_id END AS payment_id,
                  CASE WHEN event_type = 'InventoryReserved' THEN reservation_id END AS reservation_id,
                  CASE WHEN event_type NOT IN ('InventoryReserved', 'OrderCancelled') THEN amount END AS amount,
                  CASE event_type WHEN 'OrderPlaced' THEN quantity
                       WHEN 'InventoryReserved' THEN stock_quantity END AS quantity,
                  CASE event_type
                    WHEN 'PaymentProcessed' THEN CASE outcome WHEN 'PAYMENT_FAILED' THEN 'FAILED' ELSE 'SUCCESS' END
                    WHEN 'InventoryReserved' THEN CASE outcome WHEN 'CONFIRMED' THEN 'RESERVED' ELSE 'UNAVAILABLE' END
                  END AS status,
                  CASE event_type WHEN 'OrderCancelled' THEN 'Payment refunded' END AS reason
           FROM log JOIN saga USING (order_id)""",
    ),
    "saga_trace": (
        ["disturbed"],
        """SELECT transaction_id, CAST(sum(n) AS BIGINT) AS n_events, string_agg(
                  event_type || CASE WHEN n > 1 THEN '*' || CAST(n AS VARCHAR) ELSE '' END, '>' ORDER BY first_at) AS path
           FROM (SELECT transaction_id, event_type, count(*) AS n, min(seq) AS first_at FROM disturbed GROUP BY ALL)
           GROUP BY transaction_id""",
    ),
    "saga_outcomes": (
        ["saga"],
        """SELECT outcome, count(*) AS n_orders, CAST(sum(amount) AS DECIMAL(38,2)) AS amount
           FROM saga GROUP BY outcome""",
    ),
    "sla_report": (
        [],
        """SELECT CAST(ts AS DATE) AS day, count(*) AS n,
                  round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS fail_rate,
                  round(quantile_cont(value, 0.95), 6) AS p95,
                  avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) < 0.2
                    AND quantile_cont(value, 0.95) < 150 AS ok
           FROM events GROUP BY 1""",
    ),
}
_REFUNDS = (
    ["saga"],
    """SELECT payment_id, order_id, amount, order_date AS refunded_at
       FROM saga WHERE outcome = 'INVENTORY_UNAVAILABLE'""",
)
_BODIES["saga_refunds"] = _REFUNDS
_BODIES["saga_refunds_by_step"] = _REFUNDS

# A stream over the whole table has the result of the batch query.
_STREAMED = {
    "orders_routed_streamed": "orders_routed",
    "customer_order_counts_from_state": "customer_order_counts",
    "customer_total_amounts_from_state": "customer_total_amounts",
    "customer_windowed_counts_streamed": "customer_windowed_counts",
    "count_for_customers_live": "count_for_customers",
    "windowed_counts_range_live": "windowed_counts_range",
    "customer_order_counts_as_of": "customer_order_counts",
    "customer_order_count_changes": "customer_order_counts",
    "windowed_counts_with_grace_streamed": "windowed_counts_with_grace",
    "payments_committed_streamed": "payments_committed",
    "inconsistencies_streamed": "inconsistencies",
    "saga_orders_streamed": "saga_orders",
    "saga_payments_streamed": "saga_payments",
    "saga_inventory_streamed": "saga_inventory",
}
for _name, _batch in _STREAMED.items():
    _BODIES[_name] = _BODIES[_batch]
for _name in ("orders_deduped_streamed", "orders_once_streamed"):
    _BODIES[_name] = _BODIES["orders_first_per_key"]

_POSITIONED = "event_id % 11 <> 0"
_BODIES |= {
    "order_keys_deduped_streamed": (["oe"], "SELECT order_id FROM oe"),
    "orders_restarted_streamed": (["oe"], f"""SELECT {_ORDER}, "partition", "offset" FROM oe"""),
    "retries_waited_streamed": (
        ["oe"],
        """SELECT order_id, customer_id, order_date, 2 AS attempt FROM oe WHERE event_type = 'error'
           AND order_date + INTERVAL 1 SECOND <= (SELECT max(order_date) FROM oe)""",
    ),
    "orders_dual_written": (
        ["oe"],
        f"""SELECT order_id, "partition" * 4398046511104 + "offset" AS id, 'table' AS place FROM oe WHERE {_POSITIONED}
            UNION ALL SELECT order_id, NULL, 'rejected' FROM oe WHERE NOT ({_POSITIONED})
            UNION ALL SELECT order_id, NULL, 'topic' FROM oe""",
    ),
    "notifications_without_position": (
        ["oe"],
        f"""SELECT order_id, customer_id, 'Order confirmation email sent' AS message, "offset" AS msg_offset
            FROM oe WHERE NOT ({_POSITIONED})""",
    ),
    "customer_second_amounts": (
        ["oe"],
        """SELECT customer_id, max(total_amount) FILTER (rn = 2) AS second_amount FROM (
             SELECT customer_id, total_amount,
                    dense_rank() OVER (PARTITION BY customer_id ORDER BY total_amount DESC) AS rn
             FROM oe WHERE total_amount IS NOT NULL) GROUP BY customer_id""",
    ),
    "orders_sent_with_hook": (
        ["oe"],
        """SELECT order_id AS key, "partition", "offset", 'intercepted-at' AS header, '1704412800000' AS value FROM oe""",
    ),
    "saga_fallback_events": (
        ["pr"],
        """SELECT seq, CASE seq WHEN 1 THEN 'orders' ELSE 'payments' END AS topic, order_id,
                  CASE seq WHEN 1 THEN 'OrderPlaced' ELSE 'PaymentProcessed' END AS event_type,
                  CAST(NULL AS BOOLEAN) AS in_table
           FROM pr, (VALUES (1), (2)) AS s(seq) WHERE o_orderkey % 50 = 0""",
    ),
}

ORACLES = {name: _with(ctes, body) for name, (ctes, body) in _BODIES.items()}
