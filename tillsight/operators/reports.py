"""Store reports built from the table operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import MapType

from tillsight import fixed_values as fv
from tillsight.functions.numeric import rounded
from tillsight.functions.structs import present, typed_text, version
from tillsight.functions.text import fmt, with_safe_text
from tillsight.operators.churn import rfm, rfm_segments
from tillsight.operators.insights import (
    anomaly_explanation,
    churn_explanation,
    inventory_recommendation,
    pricing_strategy,
    retention_strategy,
    sales_insight,
    staffing_recommendation,
)
from tillsight.operators.menu import menu_metrics, menu_quadrants
from tillsight.operators.risk import SERIOUS_SCORE, cancel_anomalies, high_value_cancels
from tillsight.operators.sales import hourly_trend, hourly_trend_summary
from tillsight.plans.attach import attach, grouped


# The scenarios of a plan request.
SCENARIOS = ("retention_recovery", "anomaly_followup", "operations_tuning")


def _first_rows(rows: DataFrame, key: str, order: Sequence[str], most: int) -> DataFrame:
    """At most so many rows per key, in an order that all columns decide; each task passes on no more than that."""
    others = [f.name for f in rows.schema.fields if f.name not in (key, *order) and not isinstance(f.dataType, MapType)]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order, *others))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def _insight(table: dict, name: str, condition: Column, *values: Column) -> Column:
    kind, title, description = table[name]
    title = fmt(title, *values) if "%" in title else F.lit(title)
    description = fmt(description, *values) if "%" in description else F.lit(description)
    return F.when(condition, typed_text(kind, title, description))


def menu_summary(quadrants: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count per quadrant and insights naming the best star, plowhorse (by qty) and puzzle (by margin)."""

    def best(category: str, measure: str) -> Column:
        inside = F.col("category") == category
        name = F.col("menu_name").cast("string")
        return F.max_by(F.when(inside, name), F.when(inside, F.struct(measure, "menu_name")))

    counted = grouped(
        quadrants,
        keys,
        *[
            F.count_if(F.col("category") == category).alias(f"{category.lower()}_count")
            for category in ("Star", "Plowhorse", "Puzzle", "Dog")
        ],
        best("Star", "qty").alias("top_star"),
        best("Plowhorse", "qty").alias("top_plowhorse"),
        best("Puzzle", "unit_margin").alias("top_puzzle"),
    )
    c = F.col
    return counted.withColumn(
        "insights",
        present(
            _insight(fv.MENU_INSIGHTS, "Star", c("star_count") > 0, c("top_star")),
            _insight(fv.MENU_INSIGHTS, "Plowhorse", c("plowhorse_count") > 0, c("top_plowhorse")),
            _insight(fv.MENU_INSIGHTS, "Puzzle", c("puzzle_count") > 0, c("top_puzzle")),
            _insight(fv.MENU_INSIGHTS, "Dog", c("dog_count") > 0, c("dog_count")),
        ),
    )


def menu_report(sales: DataFrame, lineup: DataFrame, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """`matrix` (classified menus) and `summary` (counts, insights)."""
    matrix = menu_quadrants(menu_metrics(sales, lineup, keys), keys)
    return {"matrix": matrix, "summary": menu_summary(matrix, keys)}


def customer_summary(segments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Customers per segment and the insights of the non-empty ones."""
    # Output column per segment.
    columns = {
        "VIP": "vip_count",
        "At Risk": "at_risk_count",
        "Lost": "lost_count",
        "New": "new_count",
        "Loyal": "loyal_count",
    }
    counted = grouped(
        segments, keys, *[F.count_if(F.col("segment") == name).alias(column) for name, column in columns.items()]
    )
    return counted.withColumn(
        "insights",
        present(
            *[
                _insight(fv.CUSTOMER_INSIGHTS, name, F.col(columns[name]) > 0, F.col(columns[name]))
                for name in ("At Risk", "VIP", "Lost")
            ]
        ),
    )


def customer_report(
    visits: DataFrame, reference: object | None = None, keys: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """`segments` (classified customers) and `summary` (counts, insights)."""
    segments = rfm_segments(rfm(visits, reference, keys), keys)
    return {"segments": segments, "summary": customer_summary(segments, keys)}


def risk_summary(slots: DataFrame, risky: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Highest score, cancel total, number of risky receipts and insights (or the all-clear)."""
    serious = F.col("anomaly_score") > SERIOUS_SCORE
    rank = F.struct("anomaly_score", -F.unix_date("sales_date"), -F.col("hour"))
    slot_side = grouped(
        slots,
        keys,
        F.coalesce(rounded(F.max("anomaly_score"), 2), F.lit(0.0)).alias("anomaly_score_max"),
        F.coalesce(F.sum("cancel_count"), F.lit(0)).alias("total_cancel_count"),
        F.max_by(F.when(serious, F.col("hour")), F.when(serious, rank)).alias("peak_hour"),
    )
    receipt_side = grouped(risky, keys, F.count("*").alias("high_risk_count"))
    both = slot_side.join(receipt_side, list(keys), "left") if keys else attach(slot_side, receipt_side)
    c = F.col
    both = both.withColumn("high_risk_count", F.coalesce(c("high_risk_count"), F.lit(0)))
    found = present(
        _insight(fv.RISK_INSIGHTS, "slot", c("peak_hour").isNotNull(), c("peak_hour")),
        _insight(fv.RISK_INSIGHTS, "receipt", c("high_risk_count") > 0, c("high_risk_count")),
    )
    normal = F.array(typed_text(*fv.RISK_INSIGHTS["normal"]))
    return both.withColumn("insights", F.when(F.size(found) > 0, found).otherwise(normal))


def risk_report(receipts: DataFrame, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """`slots` (scored hours), `receipts` (large cancels) and `summary`."""
    slots = cancel_anomalies(receipts, keys)
    risky = high_value_cancels(receipts, keys=keys)
    return {"slots": slots, "receipts": risky, "summary": risk_summary(slots, risky, keys)}


def dashboard(
    sales: DataFrame,
    lineup: DataFrame,
    visits: DataFrame,
    receipts: DataFrame,
    reference: object | None = None,
    menu_sales: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The four reports and `overview`, one row with their key figures and the standing advice.

    `menu_sales` is for menu quantities that live apart from the hourly `sales`.
    """
    trend = hourly_trend(sales)
    trend_summary = hourly_trend_summary(trend)
    menus = menu_report(sales if menu_sales is None else menu_sales, lineup)
    customers = customer_report(visits, reference)
    risk = risk_report(receipts)

    overview = risk["summary"].select(F.col("anomaly_score_max").alias("risk_score"))
    for name, table in (("menu", menus["summary"]), ("churn", customers["summary"])):
        counts = [c for c in table.columns if c.endswith("_count")]
        overview = attach(overview, table.select(F.struct(*counts).alias(f"{name}_summary")))
    overview = attach(overview, trend_summary.agg(F.first("summary").alias("sales_summary")))
    context = F.struct("sales_summary", "menu_summary", "churn_summary", "risk_score")
    overview = overview.withColumn("context", F.to_json(context, {"ignoreNullFields": "false"}))
    for name, text in fv.DASHBOARD_TEXT.items():
        overview = overview.withColumn(name, F.lit(text))
    return {
        "hourly_trend": trend,
        "hourly_summary": trend_summary,
        "menu_matrix": menus["matrix"],
        "menu_summary": menus["summary"],
        "customer_segments": customers["segments"],
        "customer_summary": customers["summary"],
        "cancel_slots": risk["slots"],
        "risky_receipts": risk["receipts"],
        "risk_summary": risk["summary"],
        "overview": overview,
    }


def store_intelligence(
    stores: DataFrame, sales: DataFrame, churn: DataFrame, staffing: DataFrame | None = None
) -> DataFrame:
    """One row per row of `sales`: combined summary, up to five priority actions, and the staffing of the store.

    A store without churn input keeps its sales part. `stores` gives roi_rate, avg_order_value and
    recent_visit_count per store (0 where absent). `staffing` lists every staffing row of the store by date and
    hour (as many as the calendar has hours); the earliest supplies the staffing advice.
    """
    c = F.col
    told = ("summary", "highlights", "evidence", "warnings", "cold_start_mode")
    rows = (
        sales_insight(sales)
        .select("store_id", F.struct(*told).alias("sales"))
        .join(churn_explanation(churn).select("store_id", F.struct(*told).alias("churn")), "store_id", "left")
        .join(stores.select("store_id", "roi_rate", "avg_order_value", "recent_visit_count"), "store_id", "left")
    )
    if staffing is None:
        listed = "array<struct<date:date,hour:int,recommendation:string>>"
        rows = rows.withColumns({"advice": F.lit(None).cast("string"), "staffing": F.expr(f"cast(array() as {listed})")})
    else:
        advised = staffing_recommendation(staffing)
        hours = advised.groupBy("store_id").agg(
            F.array_sort(F.collect_list(F.struct("date", "hour", "recommendation"))).alias("staffing")
        )
        rows = rows.join(hours, "store_id", "left").withColumns(
            {
                "staffing": F.coalesce("staffing", F.array().cast(hours.schema["staffing"].dataType)),
                "advice": F.get("staffing", F.lit(0))["recommendation"],
            }
        )
    zero = F.lit(0.0)
    promotion = fmt(
        fv.STORE_PROMOTION,
        F.coalesce(c("roi_rate").cast("double"), zero),
        F.coalesce(c("avg_order_value").cast("double"), zero),
    )
    closing = F.coalesce(c("advice"), F.lit(fv.STORE_NO_STAFFING))
    visits = fmt(fv.STORE_VISITS, F.coalesce(c("recent_visit_count").cast("bigint"), F.lit(0).cast("bigint")))
    nothing = F.array().cast("array<string>")
    actions = F.concat(
        F.slice(c("sales.highlights"), 1, 2),
        F.coalesce(F.slice(c("churn.highlights"), 1, 2), nothing),
        present(c("advice")),
        F.array(visits),
    )
    summary = F.concat_ws(" ", c("sales.summary"), c("churn.summary"), promotion, closing)
    return with_safe_text(rows, "summary", summary).select(
        "store_id",
        "summary",
        F.slice(actions, 1, 5).alias("priority_actions"),
        "sales",
        "churn",
        "staffing",
        version("analysis").alias("version"),
    )


#: Lines a step's detail has at most; the others are counted in a last line.
MOST_LINES = 20


def action_plan(
    requests: DataFrame,
    *,
    churn: DataFrame | None = None,
    retention: DataFrame | None = None,
    anomaly: DataFrame | None = None,
    menu: DataFrame | None = None,
    staffing: DataFrame | None = None,
    inventory: DataFrame | None = None,
    key: str = "store_id",
    most_lines: int = MOST_LINES,
) -> DataFrame:
    """Steps, outputs and status per requested plan: as many plans as requests.

    `requests` has the key (a store, or a request id) and scenario; every input table has the key. A key without
    rows in an input skips that step. The texts of several rows (segments, hours, items) are the lines of its
    detail, sorted: those of the first `most_lines` rows (by segment, menu, date and hour, item, then all columns), and a line
    that counts the others. Only rows that a request asks for are looked at, and only those that make a line become text.
    """
    recovery, followup, tuning = SCENARIOS
    inputs = {
        "churn": (churn, churn_explanation, "summary", recovery, ()),
        "retention": (retention, retention_strategy, "summary", recovery, ("segment_name",)),
        "anomaly": (anomaly, anomaly_explanation, "summary", followup, ("anomaly_type",)),
        "menu": (menu, pricing_strategy, "summary", tuning, ("menu_id",)),
        "staffing": (staffing, staffing_recommendation, "recommendation", tuning, ("date", "hour")),
        "inventory": (inventory, inventory_recommendation, "recommendation", tuning, ("month", "item_id")),
    }
    tagged = []
    for name, (table, explain, text, scenario, order) in inputs.items():
        if table is None:
            continue
        asked = requests.where(F.col("scenario") == scenario).select(key).distinct()
        needed = table.join(asked, key, "left_semi")
        counted = needed.groupBy(key).agg(F.count("*").alias("total"))
        chosen = explain(_first_rows(needed, key, order, most_lines))
        tagged.append(chosen.select(key, F.lit(name).alias("part"), F.col(text).alias("line"), F.lit(0).cast("bigint").alias("total")))
        tagged.append(counted.select(key, F.lit(name).alias("part"), F.lit(None).cast("string").alias("line"), "total"))
    if not tagged:
        rows = requests.withColumns({name: F.lit(None).cast("string") for name in inputs})
    else:
        # One small row per line and part meets under the key.
        parts = {}
        for name in inputs:
            own = F.col("part") == name
            lines = F.array_sort(F.collect_list(F.when(own, F.col("line"))))
            others = F.sum(F.when(own, F.col("total"))) - most_lines
            more = F.when(others > 0, fmt(fv.PLAN_MORE_LINES, others))
            parts[name] = F.when(F.size(lines) > 0, F.array_join(F.concat(lines, present(more)), "\n"))
        folded = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(*(column.alias(name) for name, column in parts.items()))
        rows = requests.join(folded, key, "left")

    c = F.col
    recovery, followup, tuning = (c("scenario") == name for name in SCENARIOS)
    hold = F.lit(fv.HANDOFF_MESSAGES["pending_approval"])

    def step(when: Column, name: str, status: str, detail: Column) -> Column:
        entry = F.struct(F.lit(name).alias("name"), F.lit(status).alias("status"), detail.alias("detail"))
        return F.when(when & detail.isNotNull(), entry)

    def output(when: Column, name: str, text: Column) -> Column:
        return F.when(when & text.isNotNull(), F.struct(F.lit(name).alias("key"), text.alias("value")))

    planned = recovery & c("retention").isNotNull()
    steps = present(
        step(recovery, "analysis", "completed", c("churn")),
        step(recovery, "strategy", "completed", c("retention")),
        step(planned, "execution", "pending_approval", hold),
        step(followup, "analysis", "completed", c("anomaly")),
        step(followup, "strategy", "skipped", F.lit(fv.PLAN_ANOMALY_STRATEGY)),
        step(followup, "execution", "pending_approval", F.lit(fv.PLAN_ANOMALY_EXECUTION)),
        step(tuning, "strategy", "completed", c("menu")),
        step(tuning, "staffing", "completed", c("staffing")),
        step(tuning, "inventory", "completed", c("inventory")),
    )
    outputs = present(
        output(recovery, "analysis", c("churn")),
        output(recovery, "strategy", c("retention")),
        output(planned, "execution", hold),
        output(followup, "analysis", c("anomaly")),
        output(followup, "execution", F.lit(fv.PLAN_ANOMALY_OUTPUT)),
        output(tuning, "menu_strategy", c("menu")),
        output(tuning, "staffing", c("staffing")),
        output(tuning, "inventory", c("inventory")),
    )
    waiting = F.exists("steps", lambda entry: entry["status"] == "pending_approval")
    return (
        rows.select(*requests.columns, steps.alias("steps"), F.map_from_entries(outputs).alias("outputs"))
        .withColumn("status", F.when(waiting, "pending_approval").otherwise("completed"))
    )
