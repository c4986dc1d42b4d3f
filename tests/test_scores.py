"""Row and small-group scores against values worked out by hand."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillsight.operators.churn import churn_score
from tillsight.operators.menu import menu_pricing, menu_pricing_actions
from tillsight.operators.operations import inventory_advice, inventory_reorder, staffing_advice, staffing_gaps
from tillsight.operators.reviews import review_sentiment
from tillsight.operators.risk import anomaly_severity, event_anomalies
from tillsight.operators.sales import sales_diagnostics, sales_factors


def test_churn_score(customers):
    found = {r["customer_id"]: (r["churn_score"], r["risk_level"]) for r in rows(churn_score(customers))}
    assert found == {
        "C001": (17.43, "low"),
        "C002": (63.5, "medium"),
        "C003": (45.5, "medium"),
        "C004": (13.17, "low"),
        "C005": (32.67, "low"),
        "C006": (83.17, "high"),
    }


def test_churn_score_of_a_lost_customer(spark):
    one = spark.createDataFrame([(45.0, 2.0, 0.0)], "recency double, frequency double, coupon_use_rate double")
    assert rows(churn_score(one).select("churn_score", "risk_level")) == [{"churn_score": 81.5, "risk_level": "high"}]


def test_churn_score_keeps_null(spark):
    one = spark.createDataFrame([(None, 2.0, 0.0)], "recency double, frequency double, coupon_use_rate double")
    assert rows(churn_score(one))[0]["churn_score"] is None


def test_sentiment(review_rows):
    found = {r["review_id"]: (r["sentiment"], r["confidence"]) for r in rows(review_sentiment(review_rows))}
    assert found == {
        "R001": ("positive", 0.65),
        "R002": ("negative", 0.65),
        "R003": ("positive", 0.65),
        "R004": ("negative", 0.65),
    }


@pytest.mark.parametrize(
    "text, expected",
    [
        ("배달이 늦고 포인트 누락이 있어 아쉬웠어요", ("negative", 0.75)),
        ("정말 불친절", ("neutral", 0.55)),
        ("", ("neutral", 0.55)),
        (None, ("neutral", 0.55)),
        ("친절 맛있 빠르 깔끔 좋아요", ("positive", 0.9)),
    ],
)
def test_sentiment_of_single_texts(spark, text, expected):
    one = spark.createDataFrame([(text,)], "review_text string")
    found = review_sentiment(one).first()
    assert (found["sentiment"], found["confidence"]) == expected


def test_sentiment_with_own_words(spark):
    one = spark.createDataFrame([("GREAT food",)], "review_text string")
    assert review_sentiment(one, positive=["great"], negative=["bad"]).first()["sentiment"] == "positive"


def test_event_anomalies(event_rows):
    found = {r["event_id"]: (r["anomaly_probability"], r["severity"]) for r in rows(event_anomalies(event_rows))}
    assert found == {
        "A001": (0.3333, "low"),
        "A002": (0.3333, "low"),
        "A003": (0.5, "medium"),
        "A004": (0.5, "medium"),
    }


def test_event_anomalies_equal_amounts_and_outlier(spark):
    data = [("same", 0.1)] * 4 + [("wild", 1.0)] * 30 + [("wild", 1000.0), (None, 3.0)]
    found = event_anomalies(spark.createDataFrame(data, "event_type string, amount double"))
    got = {(r["event_type"], r["amount"]): (r["anomaly_probability"], r["severity"]) for r in rows(found)}
    assert got[("same", 0.1)] == (0.0, "low")
    assert got[("wild", 1000.0)] == (1.0, "high")
    assert got[(None, 3.0)] == (None, None)


def test_anomaly_severity(spark):
    scores = spark.createDataFrame([(80.0,), (79.9,), (50.0,), (49.9,)], "anomaly_score double")
    assert [r["severity"] for r in anomaly_severity(scores).collect()] == ["high", "medium", "medium", "low"]


def test_sales_factors(daily_sales):
    found = {r["store_id"]: r for r in rows(sales_factors(daily_sales))}
    assert found["S001"]["top_factors"] == ["customers", "channel_mix", "avg_ticket"]
    assert found["S001"]["revenue_delta_pct"] == -1.97
    assert found["S002"]["top_factors"] == ["promo", "customers", "channel_mix"]
    assert found["S002"]["revenue_delta_pct"] == -3.82
    assert found["S003"]["dominant_factor"] == "promo"
    assert found["S003"]["revenue_delta_pct"] == 4.08


def test_sales_factors_short_and_zero(spark, daily_sales):
    single = daily_sales.filter((F.col("store_id") == "S001") & (F.col("date") == "2026-01-01"))
    assert rows(sales_factors(single)) == [
        {
            "store_id": "S001",
            "dominant_factor": "revenue",
            "top_factors": ["revenue", "orders", "customers"],
            "revenue_delta_pct": 0.0,
        }
    ]
    from_zero = daily_sales.withColumn("revenue", F.when(F.dayofmonth("date") == 1, 0.0).otherwise(10.0))
    assert {r["revenue_delta_pct"] for r in rows(sales_factors(from_zero))} == {0.0}


def test_sales_factors_equal_impacts_keep_listed_order(daily_sales):
    flat = daily_sales.withColumns({c: F.lit(5.0) for c in ("revenue", "orders", "customers", "avg_ticket")})
    found = rows(sales_factors(flat.withColumn("promo_flag", F.lit(0))))
    assert all(r["top_factors"] == ["customers", "avg_ticket", "channel_mix"] for r in found)


def test_sales_diagnostics(spark):
    one = spark.createDataFrame(
        [(-12.4, -9.1, -2.6, -4.0, -3.4)],
        "revenue_delta_pct double, customer_delta_pct double, avg_ticket_delta_pct double, channel_delta_pct double, "
        "weather_impact_pct double",
    )
    found = sales_diagnostics(one).first()
    assert found["composite_gap"] == pytest.approx(-5.775)
    assert found["direction"] == "down"
    assert [d["name"] for d in found["drivers"]] == ["방문객 수", "채널 믹스", "날씨 영향", "객단가"]


def test_menu_pricing(menu_rows):
    found = {
        r["menu_id"]: (r["pricing_signal"], r["action"], r["recommended_price_min"], r["recommended_price_max"])
        for r in rows(menu_pricing(menu_rows))
    }
    assert found == {
        "M001": ("hold", "maintain", 8500, 8925),
        "M002": ("raise_price", "price_up_test", 4410, 4830),
        "M003": ("raise_price", "price_up_test", 10395, 11385),
        "M004": ("raise_price", "price_up_test", 7560, 8280),
    }


def test_menu_pricing_low_demand_and_own_signal(spark):
    data = spark.createDataFrame(
        [
            ("a", 1000, 0.6, 10.0, "hold"),
            ("b", 1000, 0.1, 10.0, "hold"),
            ("c", 1000, 0.3, 400.0, "hold"),
            ("d", 1000, 0.5, 400.0, "raise_price"),
        ],
        "menu_id string, price int, margin_rate double, quantity double, own string",
    )
    found = {r["menu_id"]: r for r in rows(menu_pricing(data, "own"))}
    assert found["a"]["pricing_signal"] == "lower_price"
    assert (found["a"]["recommended_price_min"], found["a"]["recommended_price_max"]) == (900, 980)
    assert [found[m]["action"] for m in "abcd"] == ["maintain", "cost_review", "bundle_promotion", "price_up_test"]


def test_menu_pricing_actions(spark):
    data = spark.createDataFrame([("a", 12000, 0.15, 10.0)], "menu_id string, price int, margin_rate double, quantity double")
    found = menu_pricing_actions(menu_pricing(data)).first()
    assert [a["priority"] for a in found["actions"]] == ["P0", "P1"]
    assert found["actions"][0]["expected_effect"] == "권장 가격 범위 12,600원~13,799원 내에서 마진 방어"
    assert [w["code"] for w in found["warnings"]] == ["low_margin_emergency"]


def test_staffing(staffing_rows):
    found = {
        (r["store_id"], r["hour"]): (r["gap"], r["status"], r["opportunity_cost"], r["recommendation"])
        for r in rows(staffing_advice(staffing_gaps(staffing_rows)))
    }
    assert found == {
        ("S001", 11): (1, "understaffed", 14400, "1명 추가 투입 또는 피크타임 재배치 권고"),
        ("S001", 12): (1, "understaffed", 25600, "1명 추가 투입 또는 피크타임 재배치 권고"),
        ("S002", 18): (-1, "overstaffed", 0, "1명 재배치 또는 조기 종료 검토"),
        ("S003", 19): (2, "understaffed", 46400, "2명 추가 투입 또는 피크타임 재배치 권고"),
    }


def test_inventory(stock_rows):
    found = {
        r["item_id"]: (r["risk_level"], r["reorder_qty"], r["estimated_loss_amount"])
        for r in rows(inventory_advice(inventory_reorder(stock_rows)))
    }
    assert found == {
        "I001": ("medium", 14, 8000),
        "I002": ("high", 19, 10000),
        "I010": ("low", 7, 5000),
        "I014": ("high", 21, 11000),
    }


def test_inventory_surplus(spark):
    one = spark.createDataFrame([(100.0, 103.5, 0.0)], "system_qty double, actual_qty double, loss_rate double")
    found = inventory_reorder(one).first()
    assert (found["reorder_qty"], found["estimated_loss_amount"]) == (5, -3500)
