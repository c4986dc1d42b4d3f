"""Offers, plans, targets and hand-offs."""

import pytest
from conftest import UPLOADED, rows
from pyspark.sql import functions as F

from tillsight.operators.campaigns import (
    BreakEvenWeights,
    UpliftWeights,
    campaign_break_even,
    campaign_handoff,
    campaign_uplift,
    retention_actions,
    retention_offers,
    retention_warnings,
    target_exclusions,
    target_summary,
    valid_targets,
)
from tillsight.operators.expectations import expect, expect_record, rejected_rows, split_records, valid_rows
from tillsight.operators.insights import break_even_strategy, retention_strategy, uplift_strategy

SEGMENTS = (
    "store_id string, segment_name string, customer_count long, avg_margin_per_customer double, "
    "churn_risk_level string, coupon_budget long, source_name string, uploaded_at string"
)


def segments(spark, *data):
    return spark.createDataFrame([("S001", *row, "rfm.csv", UPLOADED) for row in data], SEGMENTS)


def test_retention_offers(spark):
    table = segments(
        spark,
        ("a", 48, 18000.0, "high", 120000),
        ("b", 10, 100.0, "medium", 0),
        ("c", 1000, 100.0, "low", 1000),
        ("d", 0, 100.0, "low", 1000),
    )
    found = {r["segment_name"]: (r["discount"], r["expected_return"], r["expected_revenue"]) for r in rows(retention_offers(table))}
    assert found["a"] == (2500, 0.18, pytest.approx(155520.0))
    assert found["b"] == (2000, 0.11, pytest.approx(110.0))
    assert found["c"] == (500, 0.06, pytest.approx(6000.0))
    assert found["d"][0] == 1000


def test_retention_texts(spark):
    found = retention_strategy(segments(spark, ("이탈우려군", 48, 18000.0, "high", 120000))).first()
    assert found["summary"] == "이탈우려군 세그먼트 48명에게 2,500원 수준 복귀 오퍼를 제안합니다."
    assert [a["priority"] for a in found["actions"]] == ["P0", "P0", "P1"]
    assert found["actions"][0]["expected_effect"] == "예상 복귀율 18.0%, 예상 매출 155,520원"
    assert found["warnings"] == []
    assert found["version"]["agent"] == "strategy"
    assert found["evidence"][1]["value"] == "18,000원"
    assert "recommended_discount=2500" in found["prompt"]
    assert "{context}" not in found["prompt"]


def test_retention_warnings(spark):
    table = retention_warnings(segments(spark, ("a", 29, 1.0, "low", 0), ("b", 30, 1.0, "low", 1)))
    found = {r["segment_name"]: [w["code"] for w in r["warnings"]] for r in rows(table)}
    assert found == {"a": ["small_segment", "budget_missing"], "b": []}
    assert retention_actions(retention_offers(table)).count() == 2


PLAN = dict(
    store_id="S001",
    segment_name="loyal",
    channel="sms",
    offer_type="discount",
    offer_value=10.0,
    target_customers=1200,
    promo_days=7,
    fixed_cost=300000.0,
    menu_name="course",
    menu_price=12900.0,
    margin_rate=0.35,
    daily_avg_qty=40.0,
    avg_order_value=18000.0,
    recent_visit_count=481,
    return_rate=0.25,
    roi_rate=42.1,
    source_name="plans",
    uploaded_at=UPLOADED,
)
PLAN_SCHEMA = (
    "store_id string, segment_name string, channel string, offer_type string, offer_value double, target_customers long, "
    "promo_days int, fixed_cost double, menu_name string, menu_price double, margin_rate double, daily_avg_qty double, "
    "avg_order_value double, recent_visit_count long, return_rate double, roi_rate double, source_name string, "
    "uploaded_at string"
)


def plans(spark, *changes):
    return spark.createDataFrame([tuple({**PLAN, **change}.values()) for change in changes], PLAN_SCHEMA)


def test_break_even(spark):
    found = campaign_break_even(plans(spark, {})).first()
    assert found["expected_open_rate"] == 0.78
    assert found["expected_conversion_rate"] == 0.0951
    assert found["expected_incremental_orders"] == 114
    assert found["expected_incremental_revenue"] == 2052000.0
    assert found["expected_incremental_profit"] == 163239.0
    assert found["break_even_orders"] == 74
    assert found["break_even_revenue"] == 1332000.0
    assert found["break_even_probability"] == 0.99
    assert found["expected_roi"] == 54.41
    assert found["confidence"] == 0.8402
    assert "_net" not in found.asDict()


def test_break_even_limits(spark):
    table = plans(
        spark,
        dict(store_id="free", fixed_cost=0.0),
        dict(store_id="worthless", offer_type="coupon", offer_value=20000.0),
        dict(store_id="unknown", segment_name="other"),
        dict(store_id="channel", channel="letter"),
        dict(store_id="big", segment_name="champions", channel="push", offer_type="free_item", target_customers=5000,
             recent_visit_count=20000, return_rate=1.0, roi_rate=5000.0),
    )
    found = {r["store_id"]: r for r in rows(campaign_break_even(table))}
    assert (found["free"]["expected_roi"], found["free"]["break_even_orders"]) == (0.0, 1)
    assert found["worthless"]["break_even_orders"] == 999999
    assert found["worthless"]["break_even_probability"] == 0.01
    assert found["unknown"]["expected_open_rate"] == 0.702
    assert found["channel"]["expected_open_rate"] is None
    assert found["big"]["expected_open_rate"] == 0.7135
    assert found["big"]["expected_conversion_rate"] == 0.1777
    assert found["big"]["confidence"] == 0.93


def test_break_even_texts(spark):
    found = break_even_strategy(plans(spark, {}, dict(fixed_cost=3e6))).collect()
    assert found[0]["summary"] == (
        "loyal 세그먼트 1,200명 대상 sms 캠페인은 예상 전환율 9.5%로 손익분기 74건 대비 114건의 증분 주문이 기대됩니다."
    )
    assert found[0]["action_guide"][0] == "sms 채널 기준 예상 오픈율은 78.0%입니다."
    assert found[0]["action_guide"][3].startswith("현재 조건으로")
    assert found[1]["action_guide"][3].startswith("대상 고객 수를")
    assert found[0]["evidence"][0]["period"] == "7일 프로모션"
    assert "expected_open_rate=0.780\nexpected_conversion_rate=0.095" in found[0]["prompt"]


def test_uplift(spark):
    table = spark.createDataFrame(
        [("S001", "at_risk", "kakao", 900, 0.2, 15000.0, 350, 0.3, "plans", UPLOADED)],
        "store_id string, segment_name string, channel string, target_customers long, discount_rate double, "
        "avg_order_value double, recent_visit_count long, return_rate double, source_name string, uploaded_at string",
    )
    found = campaign_uplift(table).first()
    assert found["expected_redemption_rate"] == 0.1925
    assert found["expected_incremental_orders"] == 173
    assert found["expected_uplift_rate"] == 1.5
    assert found["expected_incremental_revenue"] == 2283600.0
    assert found["confidence"] == 0.79
    told = uplift_strategy(table).first()
    assert told["action_guide"][0] == "예상 리딤률은 19.2%입니다."
    assert "discount_rate=0.20" in told["prompt"]


TARGETS = "campaign_id string, customer_id string, consent boolean, cooldown_days int, duplicate boolean"


def test_targets(spark):
    table = spark.createDataFrame(
        [
            ("CMP-1", "C1", True, 10, False),
            ("CMP-1", "C2", False, 10, False),
            ("CMP-1", "C3", True, 3, False),
            ("CMP-2", "C1", False, 1, True),
            ("CMP-2", "C1", True, 9, False),
            ("CMP-2", "C4", True, 7, True),
            ("CMP-2", "C5", True, 7, False),
            ("CMP-2", "C5", True, 7, False),
        ],
        TARGETS,
    )
    reasons = [(r["campaign_id"], r["customer_id"], r["reason"]) for r in rows(target_exclusions(table), "campaign_id", "customer_id")]
    assert reasons == [
        ("CMP-1", "C2", "missing_consent"),
        ("CMP-1", "C3", "cooldown_active"),
        ("CMP-2", "C1", "missing_consent"),
        ("CMP-2", "C4", "duplicate_target"),
    ]
    found = {r["campaign_id"]: (r["valid_count"], r["excluded_count"]) for r in rows(target_summary(table))}
    assert found == {"CMP-1": (1, 2), "CMP-2": (2, 2)}
    assert sorted(r["customer_id"] for r in valid_targets(table).collect()) == ["C1", "C5", "C5"]


def test_handoff(spark):
    table = spark.createDataFrame(
        [("a", False, 5, "sms", True), ("b", True, 5, "sms", True), ("c", True, 1200, "coupon", False), ("d", True, 5, "point", None)],
        "campaign_id string, approved boolean, valid_target_count long, channel string, dry_run boolean",
    )
    found = {r["campaign_id"]: (r["status"], r["retries"], r["message"]) for r in rows(campaign_handoff(table))}
    assert found == {
        "a": ("pending_approval", 0, "승인 전 단계이므로 실행이 보류되었습니다."),
        "b": ("scheduled", 0, "sms 채널 발송이 dry-run으로 검증되었습니다."),
        "c": ("executed", 0, "1200건 발송을 실행 큐에 적재했습니다."),
        "d": ("scheduled", 0, "point 채널 발송이 dry-run으로 검증되었습니다."),
    }


def test_expectations(spark):
    table = plans(spark, {}, dict(channel="letter", promo_days=61), dict(margin_rate=1.2, return_rate=None))
    checked = expect_record(table, "campaign_plan")
    assert [r["violations"] for r in checked.collect()] == [[], ["channel", "promo_days"], ["margin_rate", "return_rate"]]
    assert valid_rows(checked).count() == 1
    assert rejected_rows(checked).count() == 2
    assert expect(table, {"own": table["menu_price"] > 1e6}).first()["violations"] == ["own"]


def test_every_record_rule_runs(spark):
    from tillsight.operators.expectations import RECORD_RULES

    for record, rules in RECORD_RULES.items():
        names = {word for rule in rules.values() for word in [rule.split()[0]]}
        kinds = {n: "string" if n in ("channel", "anomaly_type", "churn_risk_level", "offer_type", "customer_id", "scenario") else "boolean" if n == "consent" else "double" for n in names}
        table = spark.createDataFrame([tuple(None for _ in kinds)], ", ".join(f"{n} {k}" for n, k in kinds.items()))
        assert set(expect_record(table, record).first()["violations"]) == set(rules)


def test_records_are_split_in_one_pass(spark, tmp_path):
    computed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    data = spark.createDataFrame([(1, "sms", 0.5), (2, "mail", 2.0), (3, None, None), (4, "push", 0.0)], "id int, channel string, `odd rate` double")
    rules = {"channel": "channel in ('sms', 'push')", "rate, of all": F.col("`odd rate`").between(0, 1)}
    found = split_records(data.mapInArrow(count, data.schema), rules, str(tmp_path / "split"))
    assert found.counts == {"rows": 4, "valid": 2, "rejected": 2} and found.broken == {"channel": 2, "rate, of all": 2}
    assert sorted(found.valid.collect()) == [(1, "sms", 0.5), (4, "push", 0.0)]
    assert {r["id"]: r["violations"] for r in found.rejected.collect()} == {2: ["channel", "rate, of all"], 3: ["channel", "rate, of all"]}
    assert computed.value == 4
    empty = split_records(data.limit(0), rules, str(tmp_path / "none"))
    assert empty.counts == {"rows": 0, "valid": 0, "rejected": 0} and empty.valid.count() == empty.rejected.count() == 0


def test_weights_are_parameters(spark):
    plans = spark.createDataFrame(
        [("s", "loyal", "sms", "coupon", 3000.0, 100, 12900.0, 0.35, 30000.0, 12900.0, 500, 0.3, 40.0, 0.1)],
        "store_id string, segment_name string, channel string, offer_type string, offer_value double, target_customers int, menu_price double, "
        "margin_rate double, fixed_cost double, avg_order_value double, recent_visit_count int, return_rate double, roi_rate double, discount_rate double",
    )
    fixed = BreakEvenWeights(segments={}, other_segments=1.0, channels={"sms": 0.5}, conversion=0.1, offers={"coupon": 1.0},
                             demand=(1.0, 0.0), roi=(1.0, 1e9), visits=(1.0, 1e9), tired_above=50, tired=0.5)
    found = campaign_break_even(plans, fixed).first()
    assert (found["expected_open_rate"], found["expected_conversion_rate"], found["expected_incremental_orders"]) == (0.25, 0.1, 10)
    assert campaign_break_even(plans).first()["expected_open_rate"] == 0.78
    plain = UpliftWeights(segments={"loyal": 0.2}, channels={"sms": 1.0}, discount=(1.0, 0.0), returning=(1.0, 0.0), baseline_days=50.0)
    found = campaign_uplift(plans, plain).first()
    assert (found["expected_redemption_rate"], found["expected_incremental_orders"], found["expected_uplift_rate"]) == (0.2, 20, 1.5)
    offers = spark.createDataFrame([("high", 10, 1000.0, 0)], "churn_risk_level string, customer_count int, avg_margin_per_customer double, coupon_budget int")
    made = retention_offers(offers, discounts={"high": 5, "medium": 1, "low": 1}, returns={"high": 0.5, "medium": 0.1, "low": 0.1}).first()
    assert (made["discount"], made["expected_revenue"]) == (5, 5000.0)
