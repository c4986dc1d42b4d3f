"""Star-schema tables read as store-operations tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillsight.operators.churn import rfm, rfm_segments, segment_summary
from tillsight.operators.sales import sales_changes
from tillsight.plans.attach import attach
from tillsight.plans.shared import stored

# Fixed values of the bridges: word lists for the generated prose, extra policy terms.
POSITIVE_WORDS = ("that", "with", "this", "from")
NEGATIVE_WORDS = ("elle", "sich", "pour", "ment")
NOTICE_WORDS = ("License", "That")
POLICY_WORDS = ("license", "secret", "password", "key")
SEGMENT_NAMES = {"VIP": "champions", "Loyal": "loyal", "At Risk": "at_risk", "Lost": "lost"}
CHANNELS = ("sms", "push", "kakao")
OFFERS = {"discount": 10.0, "coupon": 3000.0, "free_item": 5000.0}
UPLOADED = "2026-03-15T09:00:00+09:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source_name", F.lit(source)).withColumn("uploaded_at", F.lit(UPLOADED).cast("timestamp"))


def _month(x: Column) -> Column:
    return F.trunc(x.cast("date"), "month")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visits_of(table(spark, sf_dir, "orders"))


def _visits_of(orders: DataFrame, *more: str) -> DataFrame:
    return orders.select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("visit_date"),
        F.col("o_totalprice").alias("payment_amount"),
        *more,
    )


def customer_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation of each customer as the store."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("store_id"))


def store_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits per store and day, folded to customer and day before the store is looked up."""
    folded = visits(spark, sf_dir).groupBy("customer_id", "visit_date").agg(F.count("*").alias("records"))
    return folded.join(customer_stores(spark, sf_dir), "customer_id").groupBy("store_id", "visit_date").agg(F.sum("records").alias("records"))


def timed_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("customer_id"),
        F.col("ts").cast("timestamp").alias("visit_date"),
        F.col("value").alias("payment_amount"),
    )


def customer_rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFM rows with the store, the mean share of discounted lines per order and the churned flag; orders are read once."""
    shares = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (F.count_if(F.col("l_discount") > 0.05) / F.count("*")).alias("share")
    )
    orders = table(spark, sf_dir, "orders").join(shares, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    found = rfm(
        _visits_of(orders, "share"),
        also=[
            F.coalesce(F.avg("share"), F.lit(0.0)).alias("coupon_use_rate"),
            F.min("visit_date").alias("first_visit"),
            F.max("visit_date").alias("latest_visit"),
        ],
    )
    return (
        found.withColumnRenamed("latest_visit", "last_visit")
        .join(customer_stores(spark, sf_dir), "customer_id", "left")
        .withColumn("churned", (F.coalesce(F.col("churn_probability"), F.lit(0.0)) > 0.8).cast("int"))
        .withColumn("last_visit_days", F.col("recency"))
    )


def sales_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store x month. Orders fold to customer x month before the store is looked up."""
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey", _month(F.col("o_orderdate")).alias("date")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"),
        F.count("*").alias("orders"),
        F.max(F.col("o_orderpriority").startswith("1").cast("int")).alias("promo"),
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("store_id"))
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("store_id", "date")
        .agg(
            F.sum("spent").cast("double").alias("revenue"),
            F.sum("orders").cast("double").alias("orders"),
            F.count("*").cast("double").alias("customers"),
            F.max("promo").alias("promo_flag"),
        )
        .withColumn("avg_ticket", F.col("revenue") / F.col("orders"))
        .withColumn("channel", F.lit("all"))
        .withColumn("weather", F.lit("na"))
    )


def hourly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "purchase")
        .select(F.hour("ts").alias("hour"), F.col("value").alias("revenue"), F.col("user_id").alias("store_id"))
    )


def menu_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("menu_name"), F.col("l_quantity").alias("qty"), F.col("l_suppkey").alias("store_id")
    )


def lineup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("menu_name"),
        F.col("p_retailprice").alias("sales_price"),
        (F.col("p_retailprice") * (0.3 + F.col("p_size") / 100)).alias("cost_price"),
    )


def menu_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu x year: price, cost, quantity and margin rate."""
    sold = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", F.year("l_shipdate").alias("store_id"))
        .agg(F.sum("l_quantity").alias("quantity"))
    )
    cost_rate = 0.3 + F.col("p_size") / 100
    return _labelled(
        sold.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("p_partkey").alias("menu_id"),
            "store_id",
            F.col("p_retailprice").cast("int").alias("price"),
            (F.col("p_retailprice") * cost_rate).alias("cost"),
            "quantity",
            (1 - cost_rate).alias("margin_rate"),
            F.col("p_type").alias("category"),
        ),
        "menu_metrics",
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts_of(table(spark, sf_dir, "events"))


def receipts_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("receipt_no"),
        F.col("user_id").alias("store_id"),
        F.to_date("ts").alias("sales_date"),
        F.date_format("ts", "HH:mm").alias("sales_time"),
        F.col("value").alias("total_amount"),
        F.when(F.col("event_type") == "error", "cancelled").otherwise("completed").alias("status"),
    )


def anomaly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("store_id"),
        "event_type",
        F.col("value").alias("amount"),
        (F.col("event_type") == "error").cast("int").alias("is_anomaly"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.07)
    return _labelled(
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.date_format("l_shipdate", "yyyy-MM").alias("month"),
            F.col("l_suppkey").alias("item_id"),
        )
        .agg(
            F.sum("l_quantity").alias("system_qty"),
            F.sum(F.when(lost, 0.0).otherwise(F.col("l_quantity"))).alias("actual_qty"),
        )
        .withColumn("loss_rate", F.try_divide(F.col("system_qty") - F.col("actual_qty"), F.col("system_qty")))
        .withColumn("store_id", F.lit("all")),
        "inventory_monthly",
    )


def staffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _labelled(
        table(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour"))
        .agg(
            F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("sales"),
            F.count_if(kind.isin("view", "click")).cast("int").alias("staff_actual"),
            F.count_if(kind.isin("purchase", "signup")).cast("int").alias("staff_recommended"),
        )
        .withColumn("store_id", F.lit("all")),
        "staffing_hourly",
    )


def store_staffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staffing rows with the user id modulo 25 as the store, to meet the nations of the sales table."""
    kind = F.col("event_type")
    return _labelled(
        table(spark, sf_dir, "events")
        .groupBy(
            (F.col("user_id") % 25).cast("int").alias("store_id"),
            F.to_date("ts").alias("date"),
            F.hour("ts").alias("hour"),
        )
        .agg(
            F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("sales"),
            F.count_if(kind.isin("view", "click")).cast("int").alias("staff_actual"),
            F.count_if(kind.isin("purchase", "signup")).cast("int").alias("staff_recommended"),
        ),
        "staffing_hourly",
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("store_id"), F.col("text").alias("review_text")
    )


def with_labels(spark: SparkSession, sf_dir: str, scored: DataFrame) -> DataFrame:
    """Add the sentiment label, null where there is none. Takes scored rows, so that no text is shuffled."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("review_id"),
        F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").alias("sentiment_label"),
    )
    return scored.join(labels, "review_id", "left")


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as raw review rows; system turns have neither rating nor label."""
    spoken = F.col("role") != "system"
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("review_id"),
        F.concat(F.lit("  "), F.col("role"), F.lit("\t")).alias("store_id"),
        F.when(spoken, F.col("turn").cast("string")).otherwise(" ").alias("rating"),
        F.col("text").alias("review_text"),
        F.when(spoken, F.when(F.col("role") == "user", "negative").otherwise("positive")).alias("sentiment_label"),
        F.lit("conversations").alias("source_name"),
        F.lit(UPLOADED).alias("uploaded_at"),
    )


def raw_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu rows as raw text; the price keeps its decimals."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("menu_id"),
        F.col("p_brand").alias("store_id"),
        F.col("p_retailprice").cast("string").alias("price"),
        F.round(F.col("p_retailprice") * 0.5, 2).cast("string").alias("cost"),
        F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")).alias("quantity"),
        F.lit("0.5").alias("margin_rate"),
        F.col("p_type").alias("category"),
        F.lit("part").alias("source_name"),
        F.lit(UPLOADED).alias("uploaded_at"),
    )


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly sales table as raw text rows."""
    rows = _labelled(sales_daily(spark, sf_dir), "sales_daily")
    names = ("date", "store_id", "revenue", "orders", "customers", "avg_ticket", "channel", "weather", "promo_flag")
    return rows.select(*[F.col(name).cast("string").alias(name) for name in names], "source_name",
                       F.lit(UPLOADED).alias("uploaded_at"))


def _as_text(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*[F.concat(F.lit(" "), F.col(n).cast("string"), F.lit("\t")).alias(n) for n in names],
                       F.lit("tables").alias("source_name"), F.lit(UPLOADED).alias("uploaded_at"))


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as raw text rows; some have a recency that is no number, some a blank store."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        key.alias("customer_id"),
        F.when(key % 19 == 0, " ").otherwise(F.col("c_nationkey").cast("string")).alias("store_id"),
        F.when(key % 17 == 0, "n/a").otherwise((key % 90).cast("string")).alias("recency"),
        (key % 12).alias("frequency"),
        F.col("c_acctbal").alias("monetary"),
        F.when(key % 23 == 0, "NaN").otherwise((key % 90).cast("string")).alias("last_visit_days"),
        ((key % 5) * 0.25).alias("coupon_use_rate"),
        (key % 2).alias("churned"),
    )
    return _as_text(rows, "customer_id", "store_id", "recency", "frequency", "monetary", "last_visit_days", "coupon_use_rate", "churned")


def raw_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw text rows of the anomaly dataset; every eleventh has no employee."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("store_id"), "event_type", F.col("value").alias("amount"), F.col("ts").alias("event_time"),
        (F.col("event_type") == "error").cast("int").alias("is_anomaly"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("E"), (F.col("user_id") % 7).cast("string"))).alias("employee_id"),
    )
    return _as_text(rows, "event_id", "store_id", "event_type", "amount", "employee_id", "event_time", "is_anomaly")


def raw_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(inventory(spark, sf_dir), "month", "store_id", "item_id", "system_qty", "actual_qty", "loss_rate")


def raw_staffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(staffing(spark, sf_dir), "date", "store_id", "hour", "sales", "staff_actual", "staff_recommended")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("notice_text"),
        F.col("source").alias("source_name"),
        F.lit(UPLOADED).cast("timestamp").alias("uploaded_at"),
    )


def benchmark_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct words of the benchmark texts as terms, grouped by their length."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).where("term <> ''")
    return words.distinct().withColumn("group", F.concat(F.lit("n"), (F.length("term") % 3).cast("string")))


def campaign_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    recency = rfm(visits(spark, sf_dir)).select("customer_id", "recency")
    return customers.join(recency, F.col("c_custkey") == F.col("customer_id"), "left").select(
        F.col("c_mktsegment").alias("campaign_id"),
        F.col("c_custkey").alias("customer_id"),
        (F.col("c_acctbal") >= 0).alias("consent"),
        (F.coalesce(F.col("recency"), F.lit(0)) % 15).alias("cooldown_days"),
        (F.col("c_custkey") % 50 == 0).alias("duplicate"),
    )


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One campaign per market segment and nation; approval and mode vary with the nation."""
    return (
        table(spark, sf_dir, "customer")
        .groupBy(F.concat_ws("-", F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("campaign_id"),
                 "c_nationkey")
        .agg(F.count("*").alias("valid_target_count"))
        .select(
            "campaign_id",
            (F.col("c_nationkey") % 3 != 0).alias("approved"),
            "valid_target_count",
            F.element_at(F.array(F.lit("coupon"), F.lit("point"), F.lit("sms")), F.col("c_nationkey") % 3 + 1).alias(
                "channel"
            ),
            (F.col("c_nationkey") % 2 == 0).alias("dry_run"),
        )
    )


def plan_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the RFM figures, segment, orders of the last 90 days, amount spent and store: one table for all campaign plans.

    Beside the latest date, for which one column is read, orders are read once.
    """
    orders = visits(spark, sf_dir)
    latest = orders.agg(F.max("visit_date").alias("latest"))
    recent = F.datediff(F.col("latest"), F.col("visit_date")) < 90
    figures = [F.count_if(recent).alias("recent"), F.sum(F.col("payment_amount").cast("decimal(18,2)")).alias("spent")]
    found = rfm_segments(rfm(attach(orders, latest), also=figures))
    return stored(found.join(customer_stores(spark, sf_dir), "customer_id"), "plan-customers")


def retention_segments(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None) -> DataFrame:
    """Retention input per store and segment; budget grows with the store key, 0 for every fifth store."""
    risk = F.when(F.col("segment") == "At Risk", "high").when(F.col("segment") == "Lost", "medium").otherwise("low")
    customers = plan_customers(spark, sf_dir) if customers is None else customers
    return _labelled(
        segment_summary(customers, ("store_id",)).select(
            "store_id",
            F.col("segment").alias("segment_name"),
            "customer_count",
            F.round(F.col("revenue") * 0.1 / F.col("customer_count"), 2).alias("avg_margin_per_customer"),
            risk.alias("churn_risk_level"),
            ((F.col("store_id") % 5) * 20000).cast("bigint").alias("coupon_budget"),
        ),
        "rfm",
    )


def _store_figures(customers: DataFrame) -> DataFrame:
    """Per store: mean order value, orders of the last 90 days, share of customers with two or more orders."""
    return customers.groupBy("store_id").agg(
        F.round(F.sum("spent").cast("double") / F.sum("frequency"), 2).alias("avg_order_value"),
        F.sum("recent").alias("recent_visit_count"),
        F.round(F.count_if(F.col("frequency") >= 2) / F.count("*"), 4).alias("return_rate"),
    )


def _plan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store segments x channels with the figures of the store."""
    named = F.lit("new")
    for segment, name in SEGMENT_NAMES.items():
        named = F.when(F.col("segment") == segment, name).otherwise(named)
    customers = plan_customers(spark, sf_dir)
    return (
        segment_summary(customers, ("store_id",))
        .join(_store_figures(customers), "store_id")
        .select(
            "store_id",
            named.alias("segment_name"),
            F.col("customer_count").alias("target_customers"),
            "avg_order_value",
            "recent_visit_count",
            "return_rate",
            F.lit(42.1).alias("roi_rate"),
            F.explode(F.array(*map(F.lit, CHANNELS))).alias("channel"),
        )
    )


def campaign_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.lit(v).alias("v")) for k, v in OFFERS.items()]))
    return _labelled(
        _plan_base(spark, sf_dir)
        .withColumn("offer", offers)
        .select(
            "*",
            F.col("offer.t").alias("offer_type"),
            F.col("offer.v").alias("offer_value"),
            F.lit(7).alias("promo_days"),
            (F.lit(30000.0) * (F.col("store_id") % 4)).alias("fixed_cost"),
            F.lit("set menu").alias("menu_name"),
            F.lit(12900.0).alias("menu_price"),
            F.lit(0.35).alias("margin_rate"),
            F.lit(40.0).alias("daily_avg_qty"),
        )
        .drop("offer"),
        "plans",
    )


def uplift_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(
        _plan_base(spark, sf_dir).withColumn("discount_rate", (F.col("store_id") % 6) * 0.1), "plans"
    )


def sales_changes_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(sales_changes(sales_daily(spark, sf_dir)), "sales").withColumn(
        "weather_impact_pct", -F.col("channel_delta_pct") / 2
    )


def churn_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn input per store from the customers' RFM rows."""
    rows = customer_rfm(spark, sf_dir)
    late = F.col("churned") == 1
    return _labelled(
        rows.groupBy("store_id").agg(
            F.count("*").alias("record_count"),
            F.count_if(late).alias("at_risk_customers"),
            F.round(F.avg(F.col("recency").cast("double")), 1).alias("delayed_visit_days"),
            F.round(F.avg("avg_interval"), 1).alias("avg_visit_cycle_days"),
            F.round(F.avg("coupon_use_rate"), 3).alias("coupon_redemption_rate"),
            F.min("first_visit").alias("window_start"),
            F.max("last_visit").alias("window_end"),
        ),
        "customers",
    )


def anomaly_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly input per store: the share of cancelled amounts as a 0-100 score."""
    rows = receipts(spark, sf_dir).withColumn("store_id", (F.col("store_id") % 25).cast("int"))
    cancelled = F.col("status") == "cancelled"
    amount = F.col("total_amount").cast("decimal(18,2)")
    return _labelled(
        rows.groupBy("store_id").agg(
            F.count("*").alias("record_count"),
            F.count_if(cancelled).alias("occurrence_count"),
            F.sum(F.when(cancelled, amount).otherwise(0)).cast("double").alias("revenue_impact"),
            F.min("sales_date").alias("window_start"),
            F.max("sales_date").alias("window_end"),
        ),
        "receipts",
    ).select(
        "*",
        F.lit("payment").alias("anomaly_type"),
        F.round(F.col("occurrence_count") * 300.0 / F.col("record_count"), 1).alias("anomaly_score"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store figures with a fixed promotion return."""
    return _store_figures(plan_customers(spark, sf_dir)).withColumn("roi_rate", F.lit(42.1))


def action_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan request per nation and scenario."""
    scenarios = ("retention_recovery", "anomaly_followup", "operations_tuning")
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("store_id"), F.explode(F.array(*map(F.lit, scenarios))).alias("scenario")
    )


def store_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity sold and kept per store, menu and supplier; lines are folded before the supplier's store is looked up."""
    lost = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.07)
    folded = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.sum("l_quantity").alias("quantity"),
        F.sum(F.when(lost, 0.0).otherwise(F.col("l_quantity"))).alias("kept"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("store_id"))
    return stored(folded.join(suppliers, "l_suppkey"), "store-sales")


def action_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Plan inputs per store: all its segments, menus, staffing hours and stock items. Lines and customers are read once."""
    sold = store_sales(spark, sf_dir)
    cost_rate = 0.3 + F.col("p_size") / 100
    menu = _labelled(
        sold.groupBy("store_id", "l_partkey").agg(F.sum("quantity").alias("quantity"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "store_id",
            F.col("p_partkey").alias("menu_id"),
            F.col("p_retailprice").cast("int").alias("price"),
            (F.col("p_retailprice") * cost_rate).alias("cost"),
            "quantity",
            (1 - cost_rate).alias("margin_rate"),
            F.col("p_type").alias("category"),
        ),
        "menu_metrics",
    )
    stock = _labelled(
        sold.groupBy("store_id", F.col("l_suppkey").alias("item_id"))
        .agg(F.sum("quantity").alias("system_qty"), F.sum("kept").alias("actual_qty"))
        .withColumn("loss_rate", F.try_divide(F.col("system_qty") - F.col("actual_qty"), F.col("system_qty")))
        .withColumn("month", F.lit("all")),
        "inventory_monthly",
    )
    return {
        "churn": churn_input(spark, sf_dir),
        "retention": retention_segments(spark, sf_dir),
        "anomaly": stored(anomaly_input(spark, sf_dir), "plan-anomalies"),
        "menu": stored(menu, "plan-menus"),
        "staffing": stored(store_staffing(spark, sf_dir), "plan-staffing"),
        "inventory": stock,
    }
