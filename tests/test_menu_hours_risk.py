"""Menu quadrants, hourly trends, cancellations."""

import statistics
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillsight.operators.menu import menu_metrics, menu_quadrants
from tillsight.operators.reports import menu_summary, risk_summary
from tillsight.operators.risk import cancel_anomalies, event_anomalies, high_value_cancels
from tillsight.operators.sales import hourly_trend, hourly_trend_summary

SALES = "menu_name string, qty int"
LINEUP = "menu_name string, sales_price double, cost_price double"


def quadrants(spark, sales, lineup):
    metrics = menu_metrics(spark.createDataFrame(sales, SALES), spark.createDataFrame(lineup, LINEUP))
    return menu_quadrants(metrics)


def test_menu_quadrants(spark):
    sales = [("star", 60), ("star", 40), ("plow", 100), ("puzzle", 5), ("dog", 5), (None, 50), ("unlisted", 500)]
    lineup = [("star", 10.0, 2.0), ("plow", 10.0, 9.0), ("puzzle", 20.0, 10.0), ("dog", 5.0, 4.0)]
    found = {r["menu_name"]: r for r in rows(quadrants(spark, sales, lineup))}
    assert {m: r["category"] for m, r in found.items()} == {
        "star": "Star",
        "plow": "Plowhorse",
        "puzzle": "Puzzle",
        "dog": "Dog",
    }
    assert found["star"]["popularity_index"] == pytest.approx(100 / 210)
    assert found["star"]["profitability_index"] == pytest.approx(8 / 5)
    assert found["star"]["total_margin"] == 800.0


def test_menu_listed_twice_counts_twice(spark):
    found = rows(quadrants(spark, [("a", 10), ("b", 10)], [("a", 3.0, 1.0), ("a", 4.0, 1.0), ("b", 2.0, 1.0)]))
    assert len(found) == 3
    assert {r["popularity_index"] for r in found} == {10 / 30}


def test_menu_mean_margin_zero(spark):
    found = {r["menu_name"]: r for r in rows(quadrants(spark, [("a", 5), ("b", 5), ("c", 5)], [("a", 3.0, 1.0), ("b", 1.0, 3.0), ("c", 1.0, 1.0)]))}
    assert found["a"]["profitability_index"] is None
    assert [found[m]["category"] for m in "abc"] == ["Star", "Plowhorse", "Plowhorse"]


def test_menu_no_quantity(spark):
    found = {r["menu_name"]: r for r in rows(quadrants(spark, [("a", 0), ("b", None)], [("a", 3.0, 1.0), ("b", 2.0, 1.0)]))}
    assert found["a"]["popularity_index"] is None
    assert found["b"]["qty"] == 0
    assert [found[m]["category"] for m in "ab"] == ["Puzzle", "Dog"]


def test_menu_equal_margins_are_profitable(spark):
    found = rows(quadrants(spark, [(m, 1) for m in "abc"], [(m, 0.3, 0.2) for m in "abc"]))
    assert {r["category"] for r in found} == {"Star"}


def test_menu_summary(spark):
    sales = [("s1", 100), ("s2", 90), ("puzzle", 1), ("dog", 1)]
    lineup = [("s1", 10.0, 2.0), ("s2", 10.0, 2.0), ("puzzle", 20.0, 10.0), ("dog", 5.0, 4.0)]
    found = menu_summary(quadrants(spark, sales, lineup)).first()
    assert (found["star_count"], found["plowhorse_count"], found["puzzle_count"], found["dog_count"]) == (2, 0, 1, 1)
    assert [i["type"] for i in found["insights"]] == ["success", "info", "danger"]
    assert found["insights"][0]["title"] == "효자 메뉴 's1' 유지"


def test_menu_summary_without_rows(spark):
    found = menu_summary(quadrants(spark, [], [])).first()
    assert (found["star_count"], found["dog_count"], found["insights"]) == (0, 0, [])


def test_hourly_trend(spark):
    data = [(9, 10.0), (9, 20.0), (11, 50.0), (12, 5.0), (15, 50.0), (20, None), (None, 7.0)]
    trend = hourly_trend(spark.createDataFrame(data, "hour int, revenue double"))
    found = {r["hour"]: r for r in rows(trend)}
    assert set(found) == {9, 11, 12, 15, 20}
    assert (found[9]["mean_revenue"], found[9]["sum_revenue"], found[9]["sale_count"]) == (15.0, 30.0, 2)
    assert (found[20]["sum_revenue"], found[20]["sale_count"]) == (0.0, 0)
    assert found[9]["moving_avg"] == 40.0
    assert found[11]["moving_avg"] == pytest.approx(85 / 3)
    assert {h for h, r in found.items() if r["is_peak"]} == {11, 15}
    summary = hourly_trend_summary(trend).first()
    assert summary["peak_hours"] == [11, 15]
    assert (summary["best_hour"], summary["worst_hour"]) == (11, 20)
    sums = [30.0, 50.0, 5.0, 50.0, 0.0]
    assert summary["volatility"] == pytest.approx(statistics.stdev(sums) / statistics.mean(sums))
    assert summary["summary"] == "오늘의 주요 피크 타임은 11, 15시이며, 11시에 최대 매출이 발생했습니다."


def test_hourly_trend_edges(spark):
    empty = hourly_trend(spark.createDataFrame([], "hour int, revenue double"))
    assert empty.count() == 0
    assert hourly_trend_summary(empty).count() == 0
    single = hourly_trend_summary(hourly_trend(spark.createDataFrame([(3, 4.0)], "hour int, revenue double"))).first()
    assert single["volatility"] is None
    zero = hourly_trend_summary(hourly_trend(spark.createDataFrame([(3, 0.0), (4, 0.0)], "hour int, revenue double")))
    assert zero.first()["volatility"] == 0.0


def receipts(spark, data):
    return spark.createDataFrame(
        data, "receipt_no string, sales_date date, sales_time string, status string, total_amount double"
    )


def test_cancel_anomalies(spark):
    day = date(2026, 3, 1)
    data = [(f"r{h}-{i}", day, f"{h:02d}:30", "cancelled" if (h == 9 and i < 3) or i == 9 else "completed", 10.0)
            for h in range(8, 13) for i in range(10)]
    data += [(None, day, "08:10", "completed", 1.0), ("x", None, "08:10", "cancelled", 1.0)]
    found = {r["hour"]: r for r in rows(cancel_anomalies(receipts(spark, data)))}
    rates = {8: 0.1, 9: 0.4, 10: 0.1, 11: 0.1, 12: 0.1}
    assert {h: r["cancel_rate"] for h, r in found.items()} == pytest.approx(rates)
    mean, std = statistics.mean(rates.values()), statistics.stdev(rates.values())
    assert {h: r["anomaly_score"] for h, r in found.items()} == pytest.approx({h: (v - mean) / std for h, v in rates.items()})
    assert found[8]["total_count"] == 10


@pytest.mark.parametrize("hours", [["09:00"], ["09:00", "10:00"]])
def test_cancel_anomalies_without_spread(spark, hours):
    data = [("a", date(2026, 3, 1), h, "completed", 1.0) for h in hours]
    assert {r["anomaly_score"] for r in rows(cancel_anomalies(receipts(spark, data)))} == {0.0}


def test_high_value_cancels(spark):
    data = [(f"r{i}", date(2026, 3, 1), "09:00", "completed", 10.0) for i in range(8)]
    data += [("big", date(2026, 3, 1), "09:00", "cancelled", 100.0), ("small", date(2026, 3, 1), "09:00", "cancelled", 20.0)]
    assert [r["receipt_no"] for r in rows(high_value_cancels(receipts(spark, data)))] == ["big"]
    none = receipts(spark, [r for r in data if r[3] == "completed"])
    assert high_value_cancels(none).count() == 0


def test_high_value_cancels_per_store(spark):
    data = [("a", 10.0, "completed")] * 5 + [("a", 61.0, "cancelled"), ("b", 1000.0, "completed"), ("b", 900.0, "cancelled")]
    table = spark.createDataFrame(data, "store_id string, total_amount double, status string")
    assert [r["store_id"] for r in rows(high_value_cancels(table, keys=["store_id"]))] == ["a"]


def test_risk_summary(spark):
    day = date(2026, 3, 1)
    calm = receipts(spark, [("a", day, "09:00", "completed", 1.0), ("b", day, "10:00", "completed", 1.0)])
    found = risk_summary(cancel_anomalies(calm), high_value_cancels(calm)).first()
    assert (found["anomaly_score_max"], found["total_cancel_count"], found["high_risk_count"]) == (0.0, 0, 0)
    assert [i["title"] for i in found["insights"]] == ["운영 리스크 정상"]
    data = [(f"r{h}", day, f"{h:02d}:00", "completed", 1.0) for h in range(12)] + [("c", day, "05:10", "cancelled", 90.0)]
    busy = receipts(spark, data)
    found = risk_summary(cancel_anomalies(busy), high_value_cancels(busy)).first()
    assert [i["title"] for i in found["insights"]] == ["비정상 취소율 급증 감지 (5시)", "고액 취소 영수증 1건 발견"]
    nothing = receipts(spark, [])
    found = risk_summary(cancel_anomalies(nothing), high_value_cancels(nothing)).first()
    assert (found["anomaly_score_max"], found["total_cancel_count"], found["high_risk_count"]) == (0.0, 0, 0)


def test_results_do_not_depend_on_partitions(spark):
    data = [(f"r{i}", date(2026, 3, 1 + i % 9), f"{i % 24:02d}:00", "cancelled" if i % 7 == 0 else "completed", i / 7) for i in range(700)]
    table = receipts(spark, data)
    expected = rows(cancel_anomalies(table.repartition(1)).withColumn("anomaly_score", F.round("anomaly_score", 9)), "sales_date", "hour")
    again = rows(cancel_anomalies(table.repartition(7)).withColumn("anomaly_score", F.round("anomaly_score", 9)), "sales_date", "hour")
    assert expected == again


def test_events_without_amount_or_type_stay(spark):
    table = spark.createDataFrame(
        [("a", "x", 1.0), ("b", "x", 3.0), ("c", "x", None), ("d", None, 2.0)], "event_id string, event_type string, amount double"
    )
    found = {r["event_id"]: (r["anomaly_probability"], r["severity"]) for r in event_anomalies(table).collect()}
    assert found == {"a": (0.3333, "low"), "b": (0.3333, "low"), "c": (None, None), "d": (None, None)}
    strict = {r["event_id"]: r["severity"] for r in event_anomalies(table, deviations=1.0, cuts=[(0.9, "top")]).collect()}
    assert strict == {"a": "top", "b": "top", "c": None, "d": None}
