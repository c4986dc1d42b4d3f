"""Shared session and small input tables."""

from __future__ import annotations

import os
import sys
from datetime import date
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from tillsight.plans.shared import release  # noqa: E402
from tillsight.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
UPLOADED = "2026-03-15T09:00:00+09:00"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", "tests", memory="4g", partitions=4, shared=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


def rows(df, *order):
    """Collected rows as dicts, sorted by the given columns."""
    found = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(found, key=lambda r: tuple(repr(r[c]) for c in order)) if order else found


@pytest.fixture
def customers(spark):
    return spark.createDataFrame(
        [
            ("C001", "S001", 7.0, 12.0, 186000.0, 0.42, 0),
            ("C002", "S001", 33.0, 4.0, 42000.0, 0.10, 1),
            ("C003", "S002", 21.0, 6.0, 78000.0, 0.20, 1),
            ("C004", "S002", 5.0, 18.0, 255000.0, 0.55, 0),
            ("C005", "S003", 14.0, 8.0, 92000.0, 0.25, 0),
            ("C006", "S003", 47.0, 2.0, 19000.0, 0.00, 1),
        ],
        "customer_id string, store_id string, recency double, frequency double, monetary double, "
        "coupon_use_rate double, churned int",
    )


@pytest.fixture
def daily_sales(spark):
    return spark.createDataFrame(
        [
            (date(2026, 1, 1), "S001", 1520000.0, 184.0, 176.0, 8636.0, "offline", "sunny", 0),
            (date(2026, 1, 1), "S002", 1310000.0, 161.0, 154.0, 8506.0, "delivery", "cloudy", 1),
            (date(2026, 1, 1), "S003", 980000.0, 129.0, 121.0, 8099.0, "offline", "rain", 0),
            (date(2026, 1, 2), "S001", 1490000.0, 179.0, 171.0, 8713.0, "offline", "cloudy", 0),
            (date(2026, 1, 2), "S002", 1260000.0, 156.0, 149.0, 8456.0, "delivery", "rain", 0),
            (date(2026, 1, 2), "S003", 1020000.0, 134.0, 126.0, 8095.0, "offline", "sunny", 1),
        ],
        "date date, store_id string, revenue double, orders double, customers double, avg_ticket double, "
        "channel string, weather string, promo_flag int",
    )


@pytest.fixture
def review_rows(spark):
    return spark.createDataFrame(
        [
            ("R001", "직원이 친절하고 음식이 빨리 나와요", "positive"),
            ("R002", "배달이 늦고 음식이 식어서 왔어요", "negative"),
            ("R003", "무난했지만 재방문 의사는 보통입니다", "neutral"),
            ("R004", "포인트 적립이 누락됐고 응대가 아쉬웠습니다", "negative"),
        ],
        "review_id string, review_text string, sentiment_label string",
    )


@pytest.fixture
def event_rows(spark):
    return spark.createDataFrame(
        [
            ("A001", "discount", 12000.0, 0),
            ("A002", "discount", 98000.0, 1),
            ("A003", "payment", 45000.0, 0),
            ("A004", "point_leak", 67000.0, 1),
        ],
        "event_id string, event_type string, amount double, is_anomaly int",
    )


@pytest.fixture
def menu_rows(spark):
    return spark.createDataFrame(
        [
            ("S001", "M001", 8500, 5100.0, 620.0, 0.40, "set", "menu.csv", UPLOADED),
            ("S001", "M002", 4200, 2600.0, 810.0, 0.38, "side", "menu.csv", UPLOADED),
            ("S002", "M003", 9900, 6800.0, 410.0, 0.31, "main", "menu.csv", UPLOADED),
            ("S003", "M004", 7200, 5000.0, 290.0, 0.31, "main", "menu.csv", UPLOADED),
        ],
        "store_id string, menu_id string, price int, cost double, quantity double, margin_rate double, "
        "category string, source_name string, uploaded_at string",
    )


@pytest.fixture
def staffing_rows(spark):
    return spark.createDataFrame(
        [
            (date(2026, 3, 1), "S001", 11, 180000.0, 3, 4, "staffing.csv", UPLOADED),
            (date(2026, 3, 1), "S001", 12, 320000.0, 4, 5, "staffing.csv", UPLOADED),
            (date(2026, 3, 1), "S002", 18, 410000.0, 5, 4, "staffing.csv", UPLOADED),
            (date(2026, 3, 1), "S003", 19, 290000.0, 2, 4, "staffing.csv", UPLOADED),
        ],
        "date date, store_id string, hour int, sales double, staff_actual int, staff_recommended int, "
        "source_name string, uploaded_at string",
    )


@pytest.fixture
def stock_rows(spark):
    return spark.createDataFrame(
        [
            ("2026-02", "S001", "I001", 120.0, 112.0, 0.067, "inventory.csv", UPLOADED),
            ("2026-02", "S001", "I002", 90.0, 80.0, 0.111, "inventory.csv", UPLOADED),
            ("2026-02", "S002", "I010", 150.0, 145.0, 0.033, "inventory.csv", UPLOADED),
            ("2026-02", "S003", "I014", 100.0, 89.0, 0.110, "inventory.csv", UPLOADED),
        ],
        "month string, store_id string, item_id string, system_qty double, actual_qty double, loss_rate double, "
        "source_name string, uploaded_at string",
    )
