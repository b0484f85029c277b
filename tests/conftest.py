from __future__ import annotations

import os
import sys
from datetime import datetime
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark import schemas  # noqa: E402
from tidemark.session import local_session  # noqa: E402

PLACED = datetime(2026, 1, 3, 10, 0, 5)


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 8, "tidemark-tests")
    session.conf.set("spark.sql.maxMetadataStringLength", "4000")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_orders(spark):
    """Orders from ``(order_id, customer_id, quantity, amount)`` rows."""

    def build(rows):
        data = [
            (o, c, "product-1", q, None if a is None else Decimal(a), PLACED, f"t-{o}")
            for o, c, q, a in rows
        ]
        return spark.createDataFrame(data, schemas.ORDER_PLACED)

    return build


def values(df, *columns):
    """The rows as a sorted list of tuples."""
    rows = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
