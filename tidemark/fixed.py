"""Names, texts and limits that users of the order services already rely on."""

# --- fixed values: topics ---------------------------------------------------------------
TOPIC_ORDERS = "orders"
TOPIC_PAYMENTS = "payments"
TOPIC_INVENTORY = "inventory"
TOPIC_HIGH_VALUE = "high-value-orders"
TOPIC_PROCESSED = "processed-orders"

TOPICS = (
    TOPIC_ORDERS,
    TOPIC_PAYMENTS,
    TOPIC_INVENTORY,
    TOPIC_HIGH_VALUE,
    TOPIC_PROCESSED,
)

# --- fixed values: statuses -------------------------------------------------------------
HIGH_VALUE = "HIGH_VALUE"
REGULAR = "REGULAR"
PROCESSED = "PROCESSED"
PENDING = "PENDING"
CANCELLED = "CANCELLED"
SUCCESS = "SUCCESS"
FAILED = "FAILED"
REFUNDED = "REFUNDED"
RESERVED = "RESERVED"
UNAVAILABLE = "UNAVAILABLE"
SENT = "SENT"
EMAIL = "EMAIL"

# --- fixed values: limits ---------------------------------------------------------------
HIGH_VALUE_THRESHOLD = 100  # inclusive: an amount of exactly 100 is high value
PAYMENT_LIMIT = 1000  # exclusive: the payment fails above it
INVENTORY_LIMIT = 500  # exclusive: the stock is unavailable above it
PUBLISH_LIMIT = 1000  # exclusive: the order event fails above it
WINDOW_SIZE = "1 minute"
GRACE = "10 seconds"
RETRY_ATTEMPTS = 3
RETRY_DELAY_MS = 1000
RETRY_MULTIPLIER = 2.0
MAX_FAILURE_RATE = 0.01
MAX_P95_MS = 500
BATCH_ROWS = 100

# --- fixed values: event types, in the order in which one transaction emits them --------
ORDER_PLACED = "OrderPlaced"
PAYMENT_PROCESSED = "PaymentProcessed"
INVENTORY_RESERVED = "InventoryReserved"
PAYMENT_REFUNDED = "PaymentRefunded"
ORDER_CANCELLED = "OrderCancelled"
SAGA_STEPS = (
    ORDER_PLACED,
    PAYMENT_PROCESSED,
    INVENTORY_RESERVED,
    PAYMENT_REFUNDED,
    ORDER_CANCELLED,
)
EVENT_VERSION = "1.0"
ORDER_SERVICE = "order-service"
PAYMENT_SERVICE = "payment-service"
INVENTORY_SERVICE = "inventory-service"
DEFAULT_PRODUCT = "product-123"

# --- fixed values: message headers ------------------------------------------------------
HEADER_CORRELATION = "correlation-id"
HEADER_SOURCE = "source"
HEADER_TIMESTAMP = "timestamp"
HEADER_VERSION = "event-version"
HEADER_MESSAGE_TYPE = "message-type"
HEADER_INTERCEPTED = "intercepted-at"
ORDER_MESSAGE_TYPE = "OrderPlacedEvent"

# --- fixed values: consumer methods, with their group and their audit message ------------
PAYMENT_CONSUMER_GROUP = "payment-service-payment-group"
IDEMPOTENT_ORDER_CONSUMER = "idempotent-order-consumer"
WITH_HEADERS = "with-headers"
CONSUMER_METHODS = {
    "idempotent-order-consumer": (
        "payment-service-order-group",
        "Order confirmation email sent",
    ),
    "auto-commit": (
        "notification-service-group",
        "Order confirmation email sent",
    ),
    "manual-commit": (
        "notification-service-manual-group",
        "Order confirmation email sent (manual commit)",
    ),
    "batch": (
        "notification-service-batch-group",
        "Order confirmation email sent (batch)",
    ),
    "specific-partition": (
        "notification-service-specific-partition-group",
        "Order confirmation email sent (specific partition)",
    ),
    "with-headers": (
        "notification-service-headers-group",
        "Order confirmation email sent (with headers - correlation-id: %s)",
    ),
    "all-headers": (
        "notification-service-all-headers-group",
        "Order confirmation email sent (all headers)",
    ),
    "concurrent": (
        "notification-service-concurrent-group",
        "Order confirmation email sent (concurrent)",
    ),
    "idempotent": (
        "notification-service-idempotent-group",
        "Order confirmation email sent (idempotent)",
    ),
}
PAYMENT_CONSUMER = "payment-consumer"
# Who may store a row; the place in this list is part of the row's id, so append only.
CONSUMERS = (*CONSUMER_METHODS, PAYMENT_CONSUMER)
# Methods whose audit row leaves the record's partition or offset empty.
METHODS_WITHOUT_PARTITION = ("all-headers", "idempotent")
METHODS_WITHOUT_OFFSET = ("all-headers", "concurrent")

# --- fixed values: texts ----------------------------------------------------------------
NOT_AVAILABLE = "N/A"
EMAIL_TEXT = "Your order %s for $%s has been placed successfully!"
SMS_TEXT = "Order %s confirmed. Amount: $%s"
PUSH_TEXT = "New order %s placed!"
CONFIRMATION_TEXT = (
    "Your order %s has been confirmed and inventory reserved! TransactionId: %s"
)
REASON_PAYMENT_FAILED = "Payment failed"
REASON_PAYMENT_REFUNDED = "Payment refunded"
REFUSED_AMOUNT = "Invalid amount - must be positive"
ORDER_EVENT_FAILED = "Amount too large - order event failed"
CONSISTENT = "Order and payment both exist - consistent state"
PAYMENT_ONLY = (
    "INCONSISTENCY: Payment exists but order does not (non-transactional issue!)"
)
ORDER_ONLY = "INCONSISTENCY: Order exists but payment does not"
NEITHER = "Neither order nor payment found"
NO_INCONSISTENCIES = (
    "No inconsistencies found - all payments have corresponding orders"
)
FOUND_INCONSISTENCIES = "Found %s inconsistency(ies)"
CURRENCY = "₹"
