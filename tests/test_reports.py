"""Explained results and combined store reports."""

from datetime import date

import pytest
from conftest import DATA, UPLOADED, rows
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tillsight.functions.structs import version
from tillsight.operators.insights import (
    anomaly_explanation,
    churn_explanation,
    inventory_recommendation,
    pricing_strategy,
    sales_insight,
    staffing_recommendation,
    with_version,
)
from tillsight.operators.reports import (
    action_plan,
    customer_report,
    dashboard,
    menu_report,
    risk_report,
    store_intelligence,
)

WINDOW = "store_id string, window_start date, window_end date, record_count long, source_name string, uploaded_at string"
HEAD = ("S001", date(2026, 3, 1), date(2026, 3, 14), 120, "in.csv", UPLOADED)


@pytest.fixture
def sales_input(spark):
    return spark.createDataFrame(
        [(*HEAD, -12.4, -9.1, -2.6, -4.0, -3.4)],
        WINDOW + ", revenue_delta_pct double, customer_delta_pct double, avg_ticket_delta_pct double, "
        "channel_delta_pct double, weather_impact_pct double",
    )


@pytest.fixture
def churn_input(spark):
    return spark.createDataFrame(
        [(*HEAD, 33, 21.0, 12.0, 0.18)],
        WINDOW + ", at_risk_customers long, delayed_visit_days double, avg_visit_cycle_days double, "
        "coupon_redemption_rate double",
    )


@pytest.fixture
def anomaly_input(spark):
    return spark.createDataFrame(
        [(*HEAD, "payment", 82.0, 4, -1250000.0)],
        WINDOW + ", anomaly_type string, anomaly_score double, occurrence_count long, revenue_impact double",
    )


def test_sales_insight(sales_input):
    found = sales_insight(sales_input).first()
    assert found["summary"] == (
        "매출은 전기 대비 -12.4% 하락했습니다. 가장 큰 요인은 방문객 수 -9.1%이며, 복합 영향 점수는 -5.8입니다."
    )
    assert found["highlights"] == [
        "방문객 수 변동 -9.1%",
        "채널 믹스 변동 -4.0%",
        "날씨 영향 변동 -3.4%",
        "저조 시간대 판촉과 채널별 가격 구성을 함께 점검하세요.",
    ]
    assert len(found["evidence"]) == 3
    assert found["evidence"][0].asDict(True)["period"] == "2026-03-01~2026-03-14"
    assert found["version"]["agent"] == "analysis"
    assert (found["warnings"], found["cold_start_mode"], found["analysis_type"]) == ([], False, "sales_diagnostics")


def test_churn_explanation(churn_input):
    found = churn_explanation(churn_input).first()
    assert (found["cycle_ratio"], found["risk_band"]) == (1.75, "high")
    assert found["save_rate"] == pytest.approx(0.198)
    assert found["summary"] == (
        "이탈 위험 고객은 33명이며 방문 지연은 평균 주기의 1.8배입니다. "
        "위험도는 high로 판단되며 현재 쿠폰 반응률 기준 예상 방어율은 19.8%입니다."
    )
    assert found["highlights"][1] == "방문 지연 21.0일, 평균 주기 12.0일"
    assert len(found["highlights"]) == 4
    calm = churn_explanation(churn_input.withColumn("delayed_visit_days", F.lit(1.0))).first()
    assert (calm["risk_band"], len(calm["highlights"])) == ("low", 3)


def test_cold_start(churn_input):
    short = churn_input.withColumn("window_end", F.lit("2026-03-05").cast("date")).withColumn("record_count", F.lit(3))
    found = churn_explanation(short).first()
    assert found["cold_start_mode"] is True
    assert [w["code"] for w in found["warnings"]] == ["insufficient_period", "insufficient_records"]


def test_anomaly_explanation(anomaly_input):
    found = anomaly_explanation(anomaly_input).first()
    assert found["severity"] == "high"
    assert found["summary"] == (
        "payment 이상이 4건 감지됐고 이상 점수는 82.0점입니다. 예상 매출 영향은 -1,250,000원이며 대응 우선순위는 high입니다."
    )
    assert len(found["highlights"]) == 4


def test_recommendations(staffing_rows, stock_rows, menu_rows):
    staffing = {r["hour"]: r for r in rows(staffing_recommendation(staffing_rows))}
    assert staffing[12]["evidence"][0]["value"] == "4명 -> 5명"
    assert staffing[12]["evidence"][1]["value"] == "320,000원"
    assert staffing[12]["evidence"][0]["period"] == "2026-03-01 12:00"
    assert "staff_recommended=5\ngap=1" in staffing[12]["prompt"]
    large = staffing_recommendation(staffing_rows.withColumn("sales", F.lit(12500000.0))).first()
    assert "sales=12500000.0\n" in large["prompt"]
    stock = {r["item_id"]: r for r in rows(inventory_recommendation(stock_rows))}
    assert stock["I002"]["recommendation"].startswith("손실 원인")
    assert stock["I002"]["evidence"][0]["value"] == "11.1%"
    assert stock["I002"]["evidence"][1]["value"] == "90 -> 80"
    menus = {r["menu_id"]: r for r in rows(pricing_strategy(menu_rows))}
    assert menus["M003"]["summary"] == (
        "메뉴 M003는 현재 마진율 31.0% 기준으로 `price_up_test` 전략이 적합하며 권장 가격 범위는 10,395원~11,385원입니다."
    )
    assert menus["M003"]["evidence"][1]["value"] == "410개 / 31.0%"


def test_unknown_agent(spark):
    with pytest.raises(KeyError):
        version("nobody")
    assert with_version(spark.range(1), "execution").first()["version"]["prompt_version"] == "execution-policy-0.1.0"


def test_store_intelligence(spark, sales_input, churn_input, staffing_rows):
    stores = spark.createDataFrame(
        [("S001", 42.1, 128000.0, 1481)], "store_id string, roi_rate double, avg_order_value double, recent_visit_count long"
    )
    found = store_intelligence(stores, sales_input, churn_input, staffing_rows).first()
    assert found["priority_actions"] == [
        "방문객 수 변동 -9.1%",
        "채널 믹스 변동 -4.0%",
        "이탈 위험 고객 33명",
        "방문 지연 21.0일, 평균 주기 12.0일",
        "1명 추가 투입 또는 피크타임 재배치 권고",
    ]
    assert "프로모션 ROI는 42.1%이고 평균 객단가는 128,000원입니다. 1명 추가" in found["summary"]
    alone = store_intelligence(stores, sales_input, churn_input).first()
    assert alone["priority_actions"][4].startswith("최근 방문 1,481건")
    assert alone["summary"].endswith("운영 권고를 생략합니다.")
    sales_only = store_intelligence(stores, sales_input, churn_input.filter("store_id = 'x'"), staffing_rows).first()
    assert sales_only["churn"] is None
    assert len(sales_only["priority_actions"]) == 4
    assert "이탈 위험" not in sales_only["summary"]
    unknown = store_intelligence(stores.filter("store_id = 'x'"), sales_input, churn_input).first()
    assert "평균 객단가는 0원입니다" in unknown["summary"]


def test_action_plan(spark, churn_input, anomaly_input, menu_rows, staffing_rows, stock_rows):
    requests = spark.createDataFrame(
        [("S001", "retention_recovery"), ("S001", "anomaly_followup"), ("S001", "operations_tuning"),
         ("S002", "retention_recovery"), ("S002", "anomaly_followup"), ("S003", "operations_tuning")],
        "store_id string, scenario string",
    )
    retention = spark.createDataFrame(
        [("S001", "이탈우려군", 33, 20000.0, "high", 99000, "rfm.csv", UPLOADED)],
        "store_id string, segment_name string, customer_count long, avg_margin_per_customer double, "
        "churn_risk_level string, coupon_budget long, source_name string, uploaded_at string",
    )
    plans = action_plan(
        requests,
        churn=churn_input,
        retention=retention,
        anomaly=anomaly_input,
        menu=menu_rows.filter("menu_id in ('M001', 'M004')"),
        staffing=staffing_rows.filter("hour in (12, 19)"),
    )
    found = {(r["store_id"], r["scenario"]): r for r in rows(plans)}
    recovery = found["S001", "retention_recovery"]
    assert [(s["name"], s["status"]) for s in recovery["steps"]] == [
        ("analysis", "completed"), ("strategy", "completed"), ("execution", "pending_approval")]
    assert recovery["status"] == "pending_approval"
    assert recovery["outputs"]["execution"] == "승인 전 단계이므로 실행이 보류되었습니다."
    tuning = found["S001", "operations_tuning"]
    assert tuning["status"] == "completed"
    assert set(tuning["outputs"]) == {"menu_strategy", "staffing"}
    followup = found["S001", "anomaly_followup"]
    assert [s["status"] for s in followup["steps"]] == ["completed", "skipped", "pending_approval"]
    assert followup["outputs"]["execution"] == "manual approval required"
    assert (found["S002", "retention_recovery"]["steps"], found["S002", "retention_recovery"]["status"]) == ([], "completed")
    assert [s["status"] for s in found["S002", "anomaly_followup"]["steps"]] == ["skipped", "pending_approval"]
    assert set(found["S003", "operations_tuning"]["outputs"]) == {"menu_strategy", "staffing"}


def test_dashboard(spark):
    sales = spark.createDataFrame([(9, 10.0, "a", 3), (10, 30.0, "b", 1)], "hour int, revenue double, menu_name string, qty int")
    lineup = spark.createDataFrame([("a", 9.0, 1.0), ("b", 5.0, 4.0)], "menu_name string, sales_price double, cost_price double")
    visits = spark.createDataFrame([("c", date(2026, 1, 1), 5.0)], "customer_id string, visit_date date, payment_amount double")
    receipts = spark.createDataFrame(
        [("r", date(2026, 1, 1), "09:00", "completed", 5.0)],
        "receipt_no string, sales_date date, sales_time string, status string, total_amount double",
    )
    tables = dashboard(sales, lineup, visits, receipts, reference="2026-01-02")
    found = tables["overview"].first()
    assert (found["risk_score"], found["menu_summary"]["star_count"], found["churn_summary"]["new_count"]) == (0.0, 1, 1)
    assert found["headline"] == "매장 운영 데이터 통합 분석"
    assert "10시에 최대 매출" in found["sales_summary"]
    for name, table in tables.items():
        assert table.columns, name


def test_customer_report_insights(spark):
    visits = spark.createDataFrame(
        [("c", date(2026, 1, 1), 5.0), ("c", date(2026, 1, 3), 5.0), ("d", date(2026, 2, 1), 5.0)],
        "customer_id string, visit_date date, payment_amount double",
    )
    found = customer_report(visits)["summary"].first()
    assert found["at_risk_count"] == 1
    assert found["insights"][0]["title"] == "이탈 위험 고객 1명 감지"


def test_reports_per_store(spark):
    sales = spark.createDataFrame([("s1", "a", 3), ("s1", "b", 1), ("s2", "a", 5)], "store_id string, menu_name string, qty int")
    lineup = spark.createDataFrame([("a", 9.0, 1.0), ("b", 5.0, 4.0)], "menu_name string, sales_price double, cost_price double")
    menus = {r["store_id"]: r for r in rows(menu_report(sales, lineup, ["store_id"])["summary"])}
    assert (menus["s1"]["star_count"], menus["s1"]["dog_count"], menus["s1"]["plowhorse_count"]) == (1, 1, 0)
    assert menus["s2"]["star_count"] == 1
    data = [("s1", f"r{h}", date(2026, 3, 1), f"{h:02d}:00", "completed", 1.0) for h in range(12)]
    data += [("s1", "c", date(2026, 3, 1), "05:10", "cancelled", 90.0), ("s2", "d", date(2026, 3, 1), "05:10", "completed", 9.0)]
    receipts = spark.createDataFrame(
        data, "store_id string, receipt_no string, sales_date date, sales_time string, status string, total_amount double"
    )
    risks = {r["store_id"]: r for r in rows(risk_report(receipts, ["store_id"])["summary"])}
    assert (risks["s1"]["high_risk_count"], risks["s1"]["peak_hour"]) == (1, 5)
    assert (risks["s2"]["high_risk_count"], risks["s2"]["insights"][0]["title"]) == (0, "운영 리스크 정상")
    visits = spark.createDataFrame(
        [("s1", "c", date(2026, 1, 1), 5.0), ("s2", "c", date(2026, 1, 3), 5.0)],
        "store_id string, customer_id string, visit_date date, payment_amount double",
    )
    found = {r["store_id"]: r["new_count"] for r in rows(customer_report(visits, keys=["store_id"])["summary"])}
    assert found == {"s1": 1, "s2": 1}


def test_plans_stay_one_per_request(spark, staffing_rows, stock_rows):
    """Two staffing rows and three stock rows of a request are lines of one plan, not six plans."""
    requests = spark.createDataFrame(
        [("r1", "operations_tuning"), ("r2", "operations_tuning"), ("r3", "retention_recovery")], "request_id string, scenario string"
    )
    staffing = staffing_rows.filter("store_id = 'S001'").withColumn("request_id", F.lit("r1"))
    first = stock_rows.limit(3).withColumn("request_id", F.lit("r1"))
    second = stock_rows.limit(1).withColumn("request_id", F.lit("r2"))
    plans = action_plan(requests, staffing=staffing, inventory=first.unionByName(second), key="request_id")
    found = {r["request_id"]: r for r in plans.collect()}
    assert plans.count() == 3 and set(found) == {"r1", "r2", "r3"}
    assert len(found["r1"]["outputs"]["staffing"].split("\n")) == 2
    assert len(found["r1"]["outputs"]["inventory"].split("\n")) == 3
    assert [s["name"] for s in found["r2"]["steps"]] == ["inventory"] and "\n" not in found["r2"]["outputs"]["inventory"]
    assert found["r3"]["steps"] == []


def test_long_steps_count_their_rest(spark, staffing_rows, stock_rows):
    """Only the first rows become lines, whatever a request brings; rows nobody asks for are not looked at."""
    requests = spark.createDataFrame([("r1", "operations_tuning"), ("r2", "operations_tuning"), ("r3", "anomaly_followup")], "request_id string, scenario string")
    hours = spark.range(1200).selectExpr("id % 24 as hour", "date_add(date '2026-01-01', cast(id div 24 as int)) as date")
    one = staffing_rows.limit(1).drop("date", "hour")
    many = hours.crossJoin(one).withColumn("request_id", F.lit("r1")).withColumn("staff_recommended", F.lit(9).cast("int"))
    few = hours.limit(2).crossJoin(one).withColumn("request_id", F.lit("r2"))
    unasked = hours.crossJoin(one).withColumn("request_id", F.lit("r3")).withColumn("sales", F.raise_error(F.lit("not asked for")).cast("double"))
    staffing = many.unionByName(few).unionByName(unasked.where("request_id = 'r9'"))
    plan = action_plan(requests, staffing=staffing, key="request_id", most_lines=3)
    found = {r["request_id"]: r["outputs"] for r in plan.collect()}
    lines = found["r1"]["staffing"].split("\n")
    assert len(lines) == 4 and lines[-1] == "외 1,197건" and len(found["r2"]["staffing"].split("\n")) == 2 and "staffing" not in found["r3"]
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in physical


@pytest.mark.parametrize("name", ["sales_insight", "churn_explanation", "store_intelligence", "campaign_break_even_guide"])
def test_texts_are_written_once(spark, name):
    """A text is formatted for its summary and its lines, not again for every check of it."""
    plan = contract.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string(") <= 25 and plan.count("regexp_replace(") <= 12, (plan.count("format_string("), plan.count("regexp_replace("))
