"""Recency, frequency, money and segments, including ties, nulls and hot customers."""

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from statistics import median

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillsight.operators.churn import rfm, rfm_segments, segment_summary
from tillsight.plans import percentiles
from tillsight.plans.percentiles import exact_percentile

DATED = "customer_id string, visit_date date, payment_amount double"
TIMED = "customer_id string, visit_date timestamp, payment_amount double"


def visits(spark, data, schema=DATED):
    typed = spark.createDataFrame(data, "customer_id string, visit_date string, payment_amount double")
    kind = "date" if schema == DATED else "timestamp"
    return typed.withColumn("visit_date", F.col("visit_date").cast(kind))


def by_customer(df):
    return {r["customer_id"]: r for r in rows(df)}


def test_means_and_fill(spark):
    data = [
        ("a", "2026-01-01", 10.0),
        ("a", "2026-01-05", 20.0),
        ("a", "2026-01-11", 5.5),
        ("b", "2026-01-03", 1.0),
        (None, "2026-01-30", 99.0),
    ]
    found = by_customer(rfm(visits(spark, data), "2026-01-21"))
    assert set(found) == {"a", "b"}
    assert found["a"]["recency"] == 10
    assert found["a"]["frequency"] == 3
    assert found["a"]["monetary"] == 35.5
    assert found["a"]["avg_interval"] == 5.0
    assert found["a"]["churn_probability"] == 1.0
    assert found["b"]["avg_interval"] == 5.0


def test_single_visits_take_thirty_days(spark):
    found = by_customer(rfm(visits(spark, [("a", "2026-01-01", None), ("b", "2026-01-10", 1.0)])))
    assert found["a"]["avg_interval"] == 30.0
    assert found["a"]["recency"] == 9
    assert found["a"]["monetary"] == 0.0
    assert found["a"]["churn_probability"] == pytest.approx(9 / 45)


def test_same_day_visits(spark):
    data = [("a", "2026-01-01", 1.0)] * 2 + [("b", "2026-01-05", 1.0)] * 2
    late = by_customer(rfm(visits(spark, data)))
    assert late["a"]["churn_probability"] == 1.0
    assert late["b"]["churn_probability"] is None
    early = by_customer(rfm(visits(spark, data), "2025-12-01"))
    assert early["a"]["churn_probability"] == 0.0


def test_missing_dates_count_as_visits(spark):
    data = [("a", "2026-01-01", 1.0), ("a", None, 1.0), ("a", "2026-01-09", 1.0)]
    for schema in (DATED, TIMED):
        found = by_customer(rfm(visits(spark, data, schema)))
        assert found["a"]["frequency"] == 3
        assert found["a"]["avg_interval"] == 8.0


def test_timestamps_floor_each_gap(spark):
    data = [
        ("a", "2026-01-01 20:00:00", 1.0),
        ("a", "2026-01-03 08:00:00", 1.0),
        ("a", "2026-01-03 21:00:00", 1.0),
        ("a", "2026-01-05 21:00:00", 1.0),
    ]
    found = by_customer(rfm(visits(spark, data, TIMED), "2026-01-05 09:00:00"))
    assert found["a"]["avg_interval"] == pytest.approx((1 + 0 + 2) / 3)
    assert found["a"]["recency"] == -1


def test_timestamps_match_brute_force(spark):
    random.seed(5)
    start = datetime(2026, 1, 1)
    data = []
    for _ in range(4000):
        who = "hot" if random.random() < 0.4 else f"c{random.randrange(60)}"
        when = start + timedelta(seconds=random.randrange(60 * 86400))
        data.append((who, when.isoformat(sep=" "), round(random.uniform(1, 100), 2)))
    found = by_customer(rfm(visits(spark, data, TIMED)))
    times = defaultdict(list)
    for who, when, _ in data:
        times[who].append(datetime.fromisoformat(when))
    assert set(found) == set(times)
    for who, stamps in times.items():
        stamps.sort()
        gaps = [(b - a).days for a, b in zip(stamps, stamps[1:])]
        if gaps:
            assert found[who]["avg_interval"] == pytest.approx(sum(gaps) / len(gaps))
        assert found[who]["frequency"] == len(stamps)


def test_segments(spark):
    data = [("a", 10, 6, 500.0, 0.9), ("b", 91, 1, 5.0, 0.5), ("c", 5, 5, 400.0, 0.1), ("d", 5, 2, 1.0, 0.1)]
    data += [("e", 5, 1, 2.0, 0.1), ("f", 5, 9, 3.0, None)]
    table = spark.createDataFrame(
        data, "customer_id string, recency int, frequency long, monetary double, churn_probability double"
    )
    found = {r["customer_id"]: r["segment"] for r in rows(rfm_segments(table))}
    assert found == {"a": "At Risk", "b": "Lost", "c": "VIP", "d": "Loyal", "e": "New", "f": "Loyal"}
    summary = {r["segment"]: r["customer_count"] for r in rows(segment_summary(rfm_segments(table)))}
    assert summary == {"At Risk": 1, "Lost": 1, "VIP": 1, "Loyal": 2, "New": 1}


def test_median_of_small_amounts(spark):
    """Amounts are neither rounded nor cut, so the middle customer of five splits them."""
    amounts = [0.001, 0.002, 0.003, 0.004, 0.014]
    table = spark.createDataFrame(
        [(f"c{i}", 1, 9, v, 0.1) for i, v in enumerate(amounts)],
        "customer_id string, recency int, frequency long, monetary double, churn_probability double",
    )
    assert exact_percentile(table, "monetary", 0.5).first()[0] == 0.003
    assert [r["segment"] for r in rows(rfm_segments(table), "customer_id")] == ["Loyal", "Loyal", "VIP", "VIP", "VIP"]


def test_segments_against_sorting(spark):
    random.seed(3)
    data = [
        (f"c{i}", random.randrange(120), random.randrange(1, 9), random.randrange(10**6) / 100, random.random())
        for i in range(400)
    ]
    table = spark.createDataFrame(
        data, "customer_id string, recency int, frequency long, monetary double, churn_probability double"
    )
    middle = median(r[3] for r in data)

    def segment(row):
        _, recency, frequency, monetary, probability = row
        if probability > 0.8:
            return "At Risk"
        if recency > 90:
            return "Lost"
        if frequency >= 5 and monetary >= middle:
            return "VIP"
        return "Loyal" if frequency >= 2 else "New"

    found = {r["customer_id"]: r["segment"] for r in rows(rfm_segments(table))}
    assert found == {r[0]: segment(r) for r in data}
    strict = rows(rfm_segments(table, at_risk_probability=0.5, lost_days=10, vip_visits=8, loyal_visits=7))
    assert Counter(r["segment"] for r in strict) != Counter(found.values())


@pytest.mark.parametrize("fraction, count", [(0.0, 7), (1.0, 7), (0.5, 1), (0.5, 2), (0.8, 300), (0.5, 300)])
def test_percentile_by_narrowing(spark, fraction, count):
    random.seed(count)
    values = [random.choice([random.randrange(-50000, 50000), 777]) / 100 for _ in range(count)]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    expected = table.select(F.percentile("v", fraction)).first()[0]
    for fanout in (2, 8, 1 << 16):
        assert exact_percentile(table, "v", fraction, fanout=fanout).first()[0] == pytest.approx(expected, abs=1e-9)


def test_percentile_against_sql(spark):
    random.seed(17)
    values = [(f"g{min(i % 7, 3)}", random.choice([1, 1e-9, 1e9, -1e300]) * random.random()) for i in range(10_000)]
    values += [("none", None), ("none", None), ("odd", float("nan")), ("odd", float("inf")), ("odd", 2.5), (None, 1.0)]
    table = spark.createDataFrame(values, "k string, v double")
    frame = table.toPandas()  # noqa: F841  read by the SQL below
    with duckdb.connect() as connection:
        usable = "case when isfinite(v) then v end"
        overall = connection.execute(f"select quantile_cont({usable}, 0.37) from frame").fetchone()[0]
        groups = dict(connection.execute(f"select k, quantile_cont({usable}, 0.37) from frame where k is not null group by k").fetchall())
    assert exact_percentile(table, "v", 0.37).first()[0] == pytest.approx(overall, rel=1e-12)
    found = {r["k"]: r["percentile"] for r in rows(exact_percentile(table, "v", 0.37, ["k"]))}
    assert found == {k: v if v is None else pytest.approx(v, rel=1e-12) for k, v in groups.items()}
    assert found["none"] is None and found["odd"] == 2.5
    empty = table.limit(0)
    assert exact_percentile(empty, "v", 0.5).first()[0] is None and exact_percentile(empty, "v", 0.5, ["k"]).count() == 0


def test_percentile_reads_its_input_twice(spark):
    """Once for the sketch and once for the counts, also where one value is very common and the others are far apart."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    random.seed(5)
    data = [(random.choice([0.0, 1e-12, 1e12]) * random.random(),) for _ in range(3000)] + [(4.0,)] * 3000 + [(None,)] * 5
    table = spark.createDataFrame(data, "v double")
    for fraction in (0.0, 0.25, 0.499, 0.9, 1.0):
        read.value = 0
        found = exact_percentile(table.mapInArrow(count, "v double"), "v", fraction, fanout=50).first()[0]
        assert found == pytest.approx(table.select(F.percentile("v", fraction)).first()[0], rel=1e-12) and read.value == 2 * len(data)


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.5, 1.0])
def test_percentile_when_the_sketch_is_far_off(spark, monkeypatch, fraction):
    """A wrong bracket costs a pass more, never a wrong result."""
    table = spark.createDataFrame([(f"k{i % 3}", float((i * 7919) % 1009)) for i in range(500)] + [("n", None)], "k string, v double")
    expected = {r["k"]: r["p"] for r in table.groupBy("k").agg(F.percentile("v", fraction).alias("p")).collect()}
    for wrong in ([900.0, 901.0], [-5.0, -4.0], [2000.0, 3000.0], [400.0, 400.0]):
        ends = F.array(*map(F.lit, wrong))
        monkeypatch.setattr(percentiles, "_ends", lambda *_, ends=ends: F.first(ends))
        found = {r["k"]: r["percentile"] for r in exact_percentile(table, "v", fraction, ["k"]).collect()}
        assert found == pytest.approx({k: v for k, v in expected.items() if v is not None} | {"n": None})


def test_approximate_percentile(spark):
    random.seed(6)
    values = [random.random() for _ in range(20_000)]
    table = spark.createDataFrame([(f"k{i % 2}", v) for i, v in enumerate(values)] + [("none", None), ("none", float("inf"))], "k string, v double")
    found = exact_percentile(table, "v", 0.3, approx=True, accuracy=100).first()[0]
    below = sum(v < found for v in values)
    assert found in values and abs(below - 0.3 * len(values)) <= len(values) / 100 + 1
    by_key = {r["k"]: r["percentile"] for r in exact_percentile(table, "v", 0.3, ["k"], approx=True).collect()}
    assert set(by_key) == {"k0", "k1", "none"} and by_key["none"] is None and by_key["k0"] in values


def test_percentile_by_narrowing_per_group(spark):
    random.seed(9)
    values = [("hot", float(random.randrange(10**9)) / 100) for _ in range(900)]
    values += [(f"g{i % 5}", float(random.randrange(1000))) for i in range(83)] + [("one", 4.0), (None, 1.0), ("one", None)]
    table = spark.createDataFrame(values, "k string, v double")
    found = {r["k"]: r["percentile"] for r in rows(exact_percentile(table, "v", 0.5, ["k"], fanout=16))}
    groups = defaultdict(list)
    for k, v in values:
        if k is not None and v is not None:
            groups[k].append(v)
    assert found == pytest.approx({k: median(v) for k, v in groups.items()})


def test_store_without_amounts_keeps_its_customers(spark):
    table = spark.createDataFrame(
        [("s1", "a", 1, 9, 5.0, 0.1), ("s2", "b", 1, 9, None, 0.1), ("s2", "c", 100, 9, None, 0.1)],
        "store_id string, customer_id string, recency int, frequency long, monetary double, churn_probability double",
    )
    found = {r["customer_id"]: r["segment"] for r in rows(rfm_segments(table, ["store_id"]))}
    assert found == {"a": "VIP", "b": "Loyal", "c": "Lost"}


@pytest.mark.parametrize("schema", [DATED, TIMED])
def test_amounts_are_not_rounded_before_they_are_added(spark, schema):
    data = [("a", "2026-01-01", 0.004)] * 1000 + [("b", "2026-01-01", 1e17), ("b", "2026-01-02", 1e17)]
    found = {r["customer_id"]: r["monetary"] for r in rows(rfm(visits(spark, data, schema)))}
    assert found == {"a": 4.0, "b": 2e17}


def test_per_store(spark):
    data = [("s1", "a", "2026-01-01", 1.0), ("s1", "a", "2026-01-03", 1.0), ("s2", "a", "2026-02-01", 2.0), (None, "a", "2026-02-01", 2.0)]
    table = spark.createDataFrame(data, "store_id string, customer_id string, visit_date string, payment_amount double")
    table = table.withColumn("visit_date", F.col("visit_date").cast("date"))
    found = {r["store_id"]: r for r in rows(rfm_segments(rfm(table, keys=["store_id"]), ["store_id"]))}
    assert set(found) == {"s1", "s2"}
    assert found["s1"]["recency"] == 0
    assert found["s2"]["avg_interval"] == 30.0


def test_keys_and_more_figures_in_one_scan(spark):
    """Keys looked up after the fold give what keys on the visits give; more aggregates come along."""
    random.seed(8)
    data = [(f"c{random.randrange(40)}", date(2026, 1, 1 + random.randrange(28)), float(random.randrange(100))) for _ in range(300)]
    plain = spark.createDataFrame(data + [("nobody", date(2026, 1, 5), 1.0)], "customer_id string, visit_date date, payment_amount double")
    stores = spark.createDataFrame([(f"c{i}", f"s{i % 3}") for i in range(40)] + [("nobody", None), ("away", "s1")], "customer_id string, store_id string")
    wanted = rfm(plain.join(stores, "customer_id"), keys=["store_id"])
    found = rfm(plain, keys=["store_id"], lookup=stores, also=[F.max("payment_amount").alias("dearest")])
    assert found.columns == [*wanted.columns, "dearest"]
    assert sorted(found.drop("dearest").collect()) == sorted(wanted.collect())
    dearest = {c: max(p for k, _, p in data if k == c) for c, *_ in data}
    assert {r["customer_id"]: r["dearest"] for r in found.collect()} == dearest
    with pytest.raises(ValueError):
        rfm(plain.withColumn("visit_date", F.col("visit_date").cast("timestamp")), also=[F.count("*").alias("n")])
