"""The registered queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillsight import fixed_values as fv, jobs
from tillsight.operators import campaigns, churn, insights, lexicon, menu, normalize, notices, operations, profile, quality
from tillsight.operators import expectations, reports, reviews, risk, sales, sufficiency
from tillsight.plans.attach import attach
from tillsight.plans.shared import new_path, stored
from tillsight.session import pin, size_shuffles
from tillsight.sources import append_metrics, load_metrics, read_feed, read_notices, read_raw, write_scores, write_table
from tillsight.streaming import slots
from tillsight.workloads import bridges as b
from tillsight.workloads import oracle_parts as sql
from tillsight.workloads import records

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function name."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            size_shuffles(pin(spark), sf_dir)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if oracle:
            ORACLES[function.__name__] = oracle
        return run

    return register


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, places) for name in names})


def joined(name: str) -> F.Column:
    return F.concat_ws("|", F.col(name)).alias(name)


# --- customers --------------------------------------------------------------------------------

_RFM_COLUMNS = """customer_id, recency, frequency, monetary, round(avg_interval, 4) as avg_interval,
  round(churn_probability, 6) as churn_probability"""


def _rfm_rounded(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, 4, "avg_interval"), 6, "churn_probability")


@query(f"with {sql.RFM} select {_RFM_COLUMNS} from rfm")
def rfm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rfm_rounded(churn.rfm(b.visits(spark, sf_dir)))


@query(f"with {sql.TIMED_VISITS}, {sql.rfm(by_date=False)} select {_RFM_COLUMNS} from rfm")
def rfm_features_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rfm_rounded(churn.rfm(b.timed_visits(spark, sf_dir)))


@query(f"with {sql.SEGMENTS} select {_RFM_COLUMNS}, segment from segments")
def rfm_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rfm_rounded(churn.rfm_segments(churn.rfm(b.visits(spark, sf_dir))))


@query(
    f"with {sql.VISITS}, {sql.rfm('store_id,')}, {sql.segments('store_id,')}"
    f" select store_id, {_RFM_COLUMNS}, segment from segments"
)
def rfm_segments_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("store_id",)
    by_store = churn.rfm(b.visits(spark, sf_dir), keys=keys, lookup=b.customer_stores(spark, sf_dir))
    return _rfm_rounded(churn.rfm_segments(by_store, keys))


@query(
    f"""with {sql.SEGMENTS} select segment, count(*) as customer_count, {sql.money('monetary')} as revenue,
    cast(sum(frequency) as bigint) as visit_count from segments group by segment"""
)
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.segment_summary(churn.rfm_segments(churn.rfm(b.visits(spark, sf_dir))))


@query(
    f"""with {sql.SEGMENTS}, counted as (
    select count(*) filter (segment = 'VIP') as vip_count, count(*) filter (segment = 'At Risk') as at_risk_count,
           count(*) filter (segment = 'Lost') as lost_count, count(*) filter (segment = 'New') as new_count,
           count(*) filter (segment = 'Loyal') as loyal_count from segments)
    select *, concat_ws('|', case when at_risk_count > 0 then concat('이탈 위험 고객 ', at_risk_count, '명 감지') end,
      case when vip_count > 0 then concat('VIP 고객 ', vip_count, '명 유지 중') end,
      case when lost_count > 0 then concat('이탈 고객 ', lost_count, '명 회복 제안') end) as insights
    from counted"""
)
def customer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = reports.customer_report(b.visits(spark, sf_dir))["summary"]
    return summary.withColumn("insights", F.concat_ws("|", F.col("insights.title")))


@query(
    f"""with {sql.CUSTOMER_RFM} select customer_id, store_id, recency, frequency,
    round(coupon_use_rate, 6) as coupon_use_rate, churn_score, risk_level from churn_rated"""
)
def churn_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("customer_id", "store_id", "recency", "frequency", "coupon_use_rate", "churn_score", "risk_level")
    return rounded(churn.churn_score(b.customer_rfm(spark, sf_dir)).select(*names), 6, "coupon_use_rate")


@query(
    f"""with {sql.CUSTOMER_RFM} select round(avg(case when (case when churned = 1 then 'high' else 'low' end)
      = (case when risk_level = 'medium' then 'high' else risk_level end) then 1.0 else 0.0 end), 4) as accuracy,
      count(*) as sample_size from churn_rated"""
)
def churn_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.churn_accuracy(churn.churn_score(b.customer_rfm(spark, sf_dir)))


_CHURN_INPUT = f"""{sql.CUSTOMER_RFM},
churn_input as (
  select store_id, count(*) as record_count, count(*) filter (churned = 1) as at_risk_customers,
         round(avg(cast(recency as double)), 1) as delayed_visit_days,
         round(avg(avg_interval), 1) as avg_visit_cycle_days,
         round(avg(coupon_use_rate), 3) as coupon_redemption_rate
  from customer_rfm group by store_id),
cycled as (
  select *, delayed_visit_days / avg_visit_cycle_days as cycle_ratio from churn_input),
banded as (
  select *, case when cycle_ratio >= 1.6 then 'high' when cycle_ratio >= 1.2 then 'medium' else 'low' end as risk_band
  from cycled),
saved as (
  select *, greatest(0.0, least(coupon_redemption_rate * cast(case risk_band when 'high' then 1.1 else 0.95 end as double),
            0.9)) as save_rate from banded)"""


@query(
    f"""with {_CHURN_INPUT} select store_id, round(cycle_ratio, 6) as cycle_ratio, risk_band,
    round(save_rate, 6) as save_rate from saved"""
)
def churn_insight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = insights.churn_insight(b.churn_input(spark, sf_dir))
    return rounded(rows.select("store_id", "cycle_ratio", "risk_band", "save_rate"), 6, "cycle_ratio", "save_rate")


@query(
    f"""with {_CHURN_INPUT} select store_id,
    printf('이탈 위험 고객은 %s명이며 방문 지연은 평균 주기의 %.1f배입니다. 위험도는 %s로 판단되며 현재 쿠폰 반응률 기준 예상 방어율은 %.1f%%입니다.',
           format('{{:,}}', at_risk_customers), cycle_ratio, risk_band, save_rate * 100) as summary,
    concat_ws('|', format('이탈 위험 고객 {{:,}}명', at_risk_customers),
      printf('방문 지연 %.1f일, 평균 주기 %.1f일', delayed_visit_days, avg_visit_cycle_days),
      printf('쿠폰 반응률 %.1f%%', coupon_redemption_rate * 100),
      case when risk_band = 'high' then '{fv.CHURN_HIGH_ADVICE}' end) as highlights,
    case when record_count < 50 then 'insufficient_records' else '' end as warnings,
    record_count < 50 as cold_start_mode, 'analysis-heuristic-0.1.0' as model_version
    from saved"""
)
def churn_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = insights.churn_explanation(b.churn_input(spark, sf_dir))
    return rows.select(
        "store_id",
        "summary",
        joined("highlights"),
        F.concat_ws("|", F.col("warnings.code")).alias("warnings"),
        "cold_start_mode",
        "version.model_version",
    )


# --- sales ------------------------------------------------------------------------------------

_CHANGE_COLUMNS = ("revenue_delta_pct", "customer_delta_pct", "avg_ticket_delta_pct", "channel_delta_pct")
_CHANGE_SQL = ", ".join(f"round({name}, 4) as {name}" for name in _CHANGE_COLUMNS)


@query(
    f"""with {sql.SALES_CHANGES} select store_id, window_start, window_end, record_count,
    round(promo_share, 6) as promo_share, {_CHANGE_SQL} from changes"""
)
def sales_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(sales.sales_changes(b.sales_daily(spark, sf_dir)), 4, *_CHANGE_COLUMNS), 6, "promo_share")


@query(
    f"""with {sql.SALES_CHANGES},
    factors as (
      select store_id, unnest([
        {{'impact': abs(customer_delta_pct) * 0.45, 'place': 0, 'name': 'customers'}},
        {{'impact': abs(avg_ticket_delta_pct) * 0.35, 'place': 1, 'name': 'avg_ticket'}},
        {{'impact': abs(channel_delta_pct) * 0.15, 'place': 2, 'name': 'channel_mix'}},
        {{'impact': promo_share * 5.0, 'place': 3, 'name': 'promo'}}]) as f from changes where record_count >= 2),
    ranked as (
      select store_id, f.name as name, row_number() over (partition by store_id order by f.impact desc, f.place) as rn
      from factors),
    tops as (select store_id, string_agg(name, '|' order by rn) as top_factors from ranked where rn <= 3 group by store_id)
    select c.store_id, split_part(coalesce(top_factors, 'revenue|orders|customers'), '|', 1) as dominant_factor,
           coalesce(top_factors, 'revenue|orders|customers') as top_factors,
           case when record_count >= 2 then {sql.exact('revenue_delta_pct', 2)} else 0.0 end as revenue_delta_pct
    from changes c left join tops t on c.store_id = t.store_id"""
)
def sales_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sales.sales_factors(b.sales_daily(spark, sf_dir))
    return rows.withColumn("top_factors", F.concat_ws("|", "top_factors"))


_DIAGNOSED = f"""{sql.SALES_CHANGES},
weathered as (select *, -channel_delta_pct / 2 as weather_impact_pct from changes),
driver_rows as (
  select store_id, unnest([
    {{'size': abs(customer_delta_pct), 'place': 0, 'name': '{fv.DRIVER_NAMES[0]}', 'value': customer_delta_pct}},
    {{'size': abs(avg_ticket_delta_pct), 'place': 1, 'name': '{fv.DRIVER_NAMES[1]}', 'value': avg_ticket_delta_pct}},
    {{'size': abs(channel_delta_pct), 'place': 2, 'name': '{fv.DRIVER_NAMES[2]}', 'value': channel_delta_pct}},
    {{'size': abs(weather_impact_pct), 'place': 3, 'name': '{fv.DRIVER_NAMES[3]}', 'value': weather_impact_pct}}]) as d
  from weathered),
driver_ranks as (
  select store_id, d.name as name, d.value as value,
         row_number() over (partition by store_id order by d.size desc, d.place) as rn from driver_rows),
drivers as (
  select store_id, string_agg(name, '|' order by rn) as drivers,
         max(case when rn = 1 then name end) as lead_name, max(case when rn = 1 then value end) as lead_value,
         string_agg(printf('%s 변동 %+.1f%%', name, value), '|' order by rn) filter (rn <= 3) as lines
  from driver_ranks group by store_id),
diagnosed as (
  select w.*, drivers, lead_name, lead_value, lines, customer_delta_pct * 0.45 as traffic_impact,
         avg_ticket_delta_pct * 0.35 as ticket_impact, channel_delta_pct * 0.15 as channel_impact,
         weather_impact_pct * 0.05 as weather_impact,
         case when revenue_delta_pct >= 0 then 'up' else 'down' end as direction
  from weathered w join drivers d on w.store_id = d.store_id)"""
_IMPACTS = ("traffic_impact", "ticket_impact", "channel_impact", "weather_impact", "composite_gap")


@query(
    f"""with {_DIAGNOSED} select store_id, {', '.join(f'round({i}, 4) as {i}' for i in _IMPACTS[:-1])},
    round(traffic_impact + ticket_impact + channel_impact + weather_impact, 4) as composite_gap, direction, drivers
    from diagnosed"""
)
def sales_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sales.sales_diagnostics(b.sales_changes_input(spark, sf_dir))
    names = F.concat_ws("|", F.col("drivers.name")).alias("drivers")
    return rounded(rows.select("store_id", *_IMPACTS, "direction", names), 4, *_IMPACTS)


_SALES_TEXT = f"""printf('매출은 전기 대비 %+.1f%% %s했습니다. 가장 큰 요인은 %s %+.1f%%이며, 복합 영향 점수는 %+.1f입니다.',
  revenue_delta_pct, case direction when 'up' then '상승' else '하락' end, lead_name, lead_value,
  traffic_impact + ticket_impact + channel_impact + weather_impact)"""


@query(
    f"""with {_DIAGNOSED} select store_id, {_SALES_TEXT} as summary,
    concat_ws('|', lines, case direction when 'up' then '{fv.SALES_ADVICE["up"]}' else '{fv.SALES_ADVICE["down"]}' end)
      as highlights,
    concat(window_start, '~', window_end) as period, printf('%+.1f%%', revenue_delta_pct) as revenue_text
    from diagnosed"""
)
def sales_insight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = insights.sales_insight(b.sales_changes_input(spark, sf_dir))
    lead = F.col("evidence")[0]
    return rows.select(
        "store_id", "summary", joined("highlights"), lead["period"].alias("period"), lead["value"].alias("revenue_text")
    )


_TREND_COLUMNS = """hour, round(mean_revenue, 4) as mean_revenue, round(sum_revenue, 4) as sum_revenue, sale_count,
  round(moving_avg, 4) as moving_avg, is_peak"""


@query(f"with {sql.hourly()} select {_TREND_COLUMNS} from trend")
def hourly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sales.hourly_trend(b.hourly_sales(spark, sf_dir))
    return rounded(rows, 4, "mean_revenue", "sum_revenue", "moving_avg")


@query(f"with {sql.hourly('store_id,')} select store_id, {_TREND_COLUMNS} from trend")
def hourly_trend_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sales.hourly_trend(b.hourly_sales(spark, sf_dir), ("store_id",))
    return rounded(rows, 4, "mean_revenue", "sum_revenue", "moving_avg")


@query(
    f"""with {sql.hourly()}, told as (
    select string_agg(cast(hour as varchar), ', ' order by hour) filter (is_peak) as peak_hours,
      arg_max(hour, sum_revenue * 100 - hour / 100) as best_hour, arg_min(hour, sum_revenue * 100 + hour / 100) as worst_hour,
      round(case when avg(sum_revenue) > 0 then stddev_samp(sum_revenue) / avg(sum_revenue) else 0.0 end, 6) as volatility
    from trend)
    select *, concat('오늘의 주요 피크 타임은 ', peak_hours, '시이며, ', best_hour, '시에 최대 매출이 발생했습니다.') as summary
    from told"""
)
def hourly_trend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sales.hourly_trend_summary(sales.hourly_trend(b.hourly_sales(spark, sf_dir)))
    hours = F.concat_ws(", ", F.col("peak_hours").cast("array<string>"))
    return rounded(rows.withColumn("peak_hours", hours), 6, "volatility")


# --- menu -------------------------------------------------------------------------------------

_MENU_COLUMNS = """menu_name, qty, round(unit_margin, 4) as unit_margin, round(total_margin, 4) as total_margin,
  round(popularity_index, 10) as popularity_index, round(profitability_index, 6) as profitability_index, category"""


def _menu_rounded(df: DataFrame, *keys: str) -> DataFrame:
    names = ("menu_name", "qty", "unit_margin", "total_margin", "popularity_index", "profitability_index", "category")
    df = rounded(df.select(*keys, *names), 4, "unit_margin", "total_margin")
    return rounded(rounded(df, 10, "popularity_index"), 6, "profitability_index")


@query(f"with {sql.menus()} select {_MENU_COLUMNS} from quadrants")
def menu_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _menu_rounded(menu.menu_quadrants(menu.menu_metrics(b.menu_sales(spark, sf_dir), b.lineup(spark, sf_dir))))


@query(f"with {sql.menus('store_id,')} select store_id, {_MENU_COLUMNS} from quadrants")
def menu_quadrants_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("store_id",)
    metrics = menu.menu_metrics(b.menu_sales(spark, sf_dir), b.lineup(spark, sf_dir), keys)
    return _menu_rounded(menu.menu_quadrants(metrics, keys), "store_id")


@query(
    f"""with {sql.menus()}, figures as (
    select count(*) filter (category = 'Star') as star_count,
    count(*) filter (category = 'Plowhorse') as plowhorse_count, count(*) filter (category = 'Puzzle') as puzzle_count,
    count(*) filter (category = 'Dog') as dog_count,
    (select cast(menu_name as varchar) from quadrants where category = 'Star' order by qty desc, menu_name desc limit 1)
      as top_star,
    (select cast(menu_name as varchar) from quadrants where category = 'Plowhorse' order by qty desc, menu_name desc
      limit 1) as top_plowhorse,
    (select cast(menu_name as varchar) from quadrants where category = 'Puzzle' order by unit_margin desc, menu_name desc
      limit 1) as top_puzzle
    from quadrants)
    select *, concat_ws('|', case when star_count > 0 then concat('효자 메뉴 ''', top_star, ''' 유지') end,
      case when plowhorse_count > 0 then concat('식사 메뉴 ''', top_plowhorse, ''' 수익성 개선') end,
      case when puzzle_count > 0 then concat('수수께끼 메뉴 ''', top_puzzle, ''' 판매 촉진') end,
      case when dog_count > 0 then '비효율 메뉴 정비' end) as insights from figures"""
)
def menu_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = reports.menu_report(b.menu_sales(spark, sf_dir), b.lineup(spark, sf_dir))["summary"]
    return summary.withColumn("insights", F.concat_ws("|", F.col("insights.title")))


_PRICE_COLUMNS = """menu_id, store_id, price, quantity, round(margin_rate, 4) as margin_rate, pricing_signal, action,
  recommended_price_min, recommended_price_max"""


@query(f"with {sql.MENU_ROWS}, {sql.priced()} select {_PRICE_COLUMNS} from priced")
def menu_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = menu.menu_pricing(b.menu_rows(spark, sf_dir))
    return rounded(rows.drop("cost", "category", "source_name", "uploaded_at"), 4, "margin_rate")


@query(
    f"""with {sql.MENU_ROWS}, {sql.priced()}, titled as (
    select *, case action when 'price_up_test' then '{fv.MENU_ACTION_TITLES["price_up_test"]}'
                when 'bundle_promotion' then '{fv.MENU_ACTION_TITLES["bundle_promotion"]}'
                when 'cost_review' then '{fv.MENU_ACTION_TITLES["cost_review"]}'
                else '{fv.MENU_ACTION_TITLES["maintain"]}' end as title from priced)
    select menu_id, store_id, title as first_title,
      format('권장 가격 범위 {{:,}}원~{{:,}}원 내에서 마진 방어', recommended_price_min, recommended_price_max) as first_effect,
      '{fv.MENU_FOLLOW_UP[0]}' as second_title, 'P0|P1' as priorities,
      case when margin_rate < 0.2 then 'low_margin_emergency' else '' end as warnings from titled"""
)
def menu_pricing_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = insights.pricing_strategy(b.menu_rows(spark, sf_dir))
    return rows.select(
        "menu_id",
        "store_id",
        F.col("actions")[0]["title"].alias("first_title"),
        F.col("actions")[0]["expected_effect"].alias("first_effect"),
        F.col("actions")[1]["title"].alias("second_title"),
        F.concat_ws("|", F.col("actions.priority")).alias("priorities"),
        F.concat_ws("|", F.col("warnings.code")).alias("warnings"),
    )


# --- risk -------------------------------------------------------------------------------------

_SLOT_COLUMNS = """sales_date, hour, total_count, cancel_count, round(cancel_rate, 6) as cancel_rate,
  round(anomaly_score, 6) as anomaly_score"""


@query(f"with {sql.cancels()} select {_SLOT_COLUMNS} from scored")
def cancel_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.cancel_anomalies(b.receipts(spark, sf_dir)), 6, "cancel_rate", "anomaly_score")


@query(f"with {sql.cancels()} select {_SLOT_COLUMNS} from scored")
def streamed_cancel_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files read as a stream of receipts, folded batch by batch, then scored."""
    path, state = new_path(spark, "streamed-slots"), new_path(spark, "stream-state")
    events = f"{sf_dir}/events.parquet"
    # A glob, as a stream reads folders: the table itself or the files in it.
    stream = spark.readStream.schema(spark.read.parquet(events).schema).parquet(f"{sf_dir}/[e]vents.parquet")
    slots.stream_slots(b.receipts_of(stream), path, state).awaitTermination()
    counted = stored(slots.streamed_slots(spark, path, risk.cancel_slots(b.receipts(spark, sf_dir)).schema), "cancel-slots")
    return rounded(risk.slot_anomalies(counted), 6, "cancel_rate", "anomaly_score")


@query(f"with {sql.cancels('store_id,')} select store_id, {_SLOT_COLUMNS} from scored")
def cancel_anomalies_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.cancel_anomalies(b.receipts(spark, sf_dir), ("store_id",)), 6, "cancel_rate", "anomaly_score")


@query(f"with {sql.cancels()}, {sql.HIGH_VALUE} select receipt_no, store_id, sales_date, total_amount, status from risky")
def high_value_cancels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.high_value_cancels(b.receipts(spark, sf_dir)).drop("sales_time")


@query(
    f"""with {sql.cancels()}, {sql.HIGH_VALUE}, figures as (
    select coalesce(round(max(anomaly_score), 2), 0.0) as anomaly_score_max,
           cast(sum(cancel_count) as bigint) as total_cancel_count,
           (select hour from scored where anomaly_score > 2.0 order by anomaly_score desc, sales_date, hour limit 1)
             as peak_hour,
           (select count(*) from risky) as high_risk_count from scored)
    select *, case when peak_hour is null and high_risk_count = 0 then '운영 리스크 정상' else
      concat_ws('|', case when peak_hour is not null then concat('비정상 취소율 급증 감지 (', peak_hour, '시)') end,
                case when high_risk_count > 0 then concat('고액 취소 영수증 ', high_risk_count, '건 발견') end) end as insights
    from figures"""
)
def risk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = reports.risk_report(b.receipts(spark, sf_dir))["summary"]
    return summary.withColumn("insights", F.concat_ws("|", F.col("insights.title")))


@query(
    f"""with {sql.EVENTS_SCORED} select event_id, store_id, event_type, amount, is_anomaly, anomaly_probability,
    case when anomaly_probability >= 0.7 then 'high' when anomaly_probability >= 0.4 then 'medium' else 'low' end as severity
    from events_scored"""
)
def event_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.event_anomalies(b.anomaly_events(spark, sf_dir))


@query(
    f"""with {sql.EVENTS_SCORED}, best as (
    select is_anomaly from events_scored order by anomaly_probability desc, event_id limit 100)
    select round(avg(is_anomaly), 4) as precision_at_k, count(*) as ranked_count from best"""
)
def event_precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = risk.event_anomalies(b.anomaly_events(spark, sf_dir))
    return quality.precision_at_k(scored, "is_anomaly", "anomaly_probability", 100, "event_id")


@query(
    f"""with {sql.EVENTS_SCORED}, placed as (
    select user_id % 25 as store_id, is_anomaly,
      row_number() over (partition by user_id % 25 order by anomaly_probability desc, event_id) as place
    from events_scored join events using (event_id))
    select cast(store_id as integer) as store_id, round(avg(is_anomaly), 4) as precision_at_k, count(*) as ranked_count
    from placed where place <= 20 group by store_id"""
)
def event_precision_at_k_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = risk.event_anomalies(b.anomaly_events(spark, sf_dir)).withColumn("store_id", (F.col("store_id") % 25).cast("int"))
    return quality.precision_at_k(scored, "is_anomaly", "anomaly_probability", 20, "event_id", ["store_id"])


_ANOMALY_INPUT = f"""anomalies as (
  select cast(user_id % 25 as integer) as store_id, count(*) as record_count,
         count(*) filter (event_type = 'error') as occurrence_count,
         coalesce({sql.money("case when event_type = 'error' then value else 0 end")}, 0.0) as revenue_impact,
         cast(min(ts) as date) as window_start, cast(max(ts) as date) as window_end from events group by user_id % 25),
anomaly_rows as (
  select *, round(occurrence_count * 300.0 / record_count, 1) as anomaly_score from anomalies),
anomaly_rated as (
  select *, case when anomaly_score >= 80 then 'high' when anomaly_score >= 50 then 'medium' else 'low' end as severity
  from anomaly_rows)"""


@query(
    f"""with {_ANOMALY_INPUT} select store_id, anomaly_score, severity,
    format('payment 이상이 {{}}건 감지됐고 이상 점수는 {{:.1f}}점입니다. 예상 매출 영향은 {{:,}}원이며 대응 우선순위는 {{}}입니다.',
      occurrence_count, anomaly_score, cast(round_even(revenue_impact, 0) as bigint), severity) as summary from anomaly_rated"""
)
def anomaly_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = insights.anomaly_explanation(b.anomaly_input(spark, sf_dir))
    return rows.select("store_id", "anomaly_score", "severity", "summary")


# --- reviews, staffing, inventory -------------------------------------------------------------


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = reviews.review_sentiment(
        b.reviews(spark, sf_dir), positive=b.POSITIVE_WORDS, negative=b.NEGATIVE_WORDS
    ).drop("review_text")
    return b.with_labels(spark, sf_dir, scored)


@query(f"with {sql.REVIEWS} select review_id, store_id, sentiment_label, sentiment, confidence from rated")
def review_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir)


@query(
    f"""with {sql.REVIEWS} select round(avg(case when sentiment_label = sentiment then 1.0 else 0.0 end), 4) as accuracy,
    count(*) as sample_size from rated where sentiment_label is not null"""
)
def sentiment_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _rated(spark, sf_dir).filter(F.col("sentiment_label").isNotNull())
    return quality.accuracy(labelled, "sentiment_label", "sentiment")


@query(
    f"""with {sql.staffing()} select date, store_id, hour, sales, staff_actual, staff_recommended,
    cast(gap as integer) as gap, status, cast(opportunity_cost as bigint) as opportunity_cost, recommendation from staffed"""
)
def staffing_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = operations.staffing_advice(operations.staffing_gaps(b.staffing(spark, sf_dir)))
    return rows.drop("source_name", "uploaded_at")


@query(
    f"""with {sql.staffing()}, told as (
    select store_id, date, hour, unnest([
      {{'metric': '실투입 대비 권장 인력', 'value': concat(staff_actual, '명 -> ', staff_recommended, '명')}},
      {{'metric': '시간대 매출', 'value': format('{{:,}}원', cast(round_even(sales, 0) as bigint))}}]) as e from staffed)
    select store_id, date, hour, e.metric as metric, e.value as value, concat(date, ' ', hour, ':00') as period,
      'staffing_hourly' as source from told"""
)
def staffing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = insights.staffing_recommendation(b.staffing(spark, sf_dir))
    return rows.select("store_id", "date", "hour", F.explode("evidence").alias("e")).select(
        "store_id", "date", "hour", "e.metric", "e.value", "e.period", F.col("e.source.name").alias("source")
    )


@query(
    f"""with {sql.STOCK} select month, 'all' as store_id, item_id, system_qty, actual_qty,
    round(loss_rate, 6) as loss_rate, risk_level, reorder_qty, estimated_loss_amount,
    case risk_level when 'high' then '{fv.INVENTORY_ADVICE["high"]}' when 'medium' then '{fv.INVENTORY_ADVICE["medium"]}'
      else '{fv.INVENTORY_ADVICE["low"]}' end as recommendation from reordered"""
)
def inventory_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = operations.inventory_advice(operations.inventory_reorder(b.inventory(spark, sf_dir)))
    return rounded(rows.drop("source_name", "uploaded_at"), 6, "loss_rate")


@query(
    f"""with {sql.STOCK} select month, item_id, concat('당신은 재고 운영 분석가다. 손실율과 실사 차이를 바탕으로 발주 및 관리 권고를 작성하라.', chr(10),
    '제약:', chr(10), '- 손실 원인 점검 문구 포함', chr(10), '- 발주 보정량을 포함', chr(10), '입력:', chr(10),
    'store_id=all', chr(10), 'item_id=', item_id, chr(10), 'loss_rate=', printf('%.3f', loss_rate), chr(10),
    'system_qty=', printf('%.1f', system_qty), chr(10), 'actual_qty=', printf('%.1f', actual_qty), chr(10),
    'reorder_qty=', reorder_qty, chr(10), 'estimated_loss_amount=', estimated_loss_amount, chr(10)) as prompt
    from reordered"""
)
def inventory_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.inventory_recommendation(b.inventory(spark, sf_dir)).select("month", "item_id", "prompt")


def _prompt_sql(task: str, *names: tuple[str, str]) -> str:
    """A task's template with `name=value` lines for its context."""
    lines = ", ".join(f"concat('{name}=', {value})" for name, value in names)
    return f"replace('{fv.PROMPTS[task]}', '{{context}}', concat_ws(chr(10), {lines}))"


@query(
    f"""with {sql.staffing()} select date, hour, {_prompt_sql(
        "staffing", ("store_id", "store_id"), ("hour", "hour"), ("sales", "sales"), ("staff_actual", "staff_actual"),
        ("staff_recommended", "staff_recommended"), ("gap", "gap"), ("opportunity_cost", "opportunity_cost"))} as prompt from staffed"""
)
def staffing_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.staffing_recommendation(b.staffing(spark, sf_dir)).select("date", "hour", "prompt")


@query(
    f"""with {sql.RETENTION} select store_id, segment_name, {_prompt_sql(
        "retention_offer", ("store_id", "store_id"), ("segment_name", "segment_name"), ("customer_count", "customer_count"),
        ("churn_risk_level", "churn_risk_level"), ("coupon_budget", "coupon_budget"),
        ("recommended_discount", "cast(discount as bigint)"))} as prompt from offers"""
)
def retention_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.retention_strategy(b.retention_segments(spark, sf_dir)).select("store_id", "segment_name", "prompt")


# --- campaigns --------------------------------------------------------------------------------


@query(
    f"""with {sql.RETENTION} select store_id, segment_name, customer_count, avg_margin_per_customer, churn_risk_level,
    coupon_budget, cast(discount as bigint) as discount, expected_return, round(expected_revenue, 2) as expected_revenue,
    concat_ws('|', case when customer_count < 30 then 'small_segment' end,
              case when coupon_budget = 0 then 'budget_missing' end) as warnings,
    format('{{}} 세그먼트 {{}}명에게 {{:,}}원 수준 복귀 오퍼를 제안합니다.', segment_name, customer_count,
           cast(discount as bigint)) as summary,
    format('예상 복귀율 {{:.1f}}%, 예상 매출 {{:,}}원', expected_return * 100,
           cast(round_even(expected_revenue, 0) as bigint)) as first_effect
    from offers"""
)
def retention_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = insights.retention_strategy(b.retention_segments(spark, sf_dir))
    rows = rows.withColumns(
        {
            "warnings": F.concat_ws("|", F.col("warnings.code")),
            "first_effect": F.col("actions")[0]["expected_effect"],
        }
    )
    return rounded(
        rows.drop("actions", "evidence", "version", "prompt", "source_name", "uploaded_at"), 2, "expected_revenue"
    )


_BREAK_EVEN = f"""{sql.PLANS},
offered as (
  select *, unnest([{{'t': 'discount', 'v': 10.0::double}}, {{'t': 'coupon', 'v': 3000.0::double}},
                    {{'t': 'free_item', 'v': 5000.0::double}}]) as offer,
         30000.0::double * (store_id % 4) as fixed_cost from plans),
biased as (
  select *, offer.t as offer_type, offer.v as offer_value,
    cast(case segment_name when 'champions' then 1.15 when 'loyal' then 1.0 when 'at_risk' then 0.84
         when 'lost' then 0.62 else 0.9 end as double) as response,
    cast(case channel when 'sms' then 0.78 when 'push' then 0.66 else 0.72 end as double) as opening,
    cast(case offer.t when 'discount' then 1.0 + least(offer.v / 100, 0.25) when 'coupon' then 1.08 else 1.12 end
         as double) as pull
  from offered),
rated as (
  select *, least(0.92, opening * response * cast(case when target_customers > 2000 then 0.94 else 1.0 end as double))
      as open_rate,
    least(0.45, greatest(0.03, cast(0.08 as double) * response * pull
      * least(1.25, greatest(0.65, 0.85 + return_rate * 1.1))
      * least(1.2, greatest(0.8, 0.92 + roi_rate / 2000))
      * least(1.15, greatest(0.85, 0.9 + recent_visit_count / 4000)))) as conversion,
    greatest(12900.0 - case offer_type when 'discount' then 12900.0 * (offer_value / 100) else offer_value end, 0.0)
      as net
  from biased),
ordered as (
  select *, cast(round_even(target_customers * conversion, 0) as bigint) as orders, greatest(net * 0.35, 0.0) as unit,
         greatest(avg_order_value, net) as basket from rated),
judged as (
  select *, orders * unit - fixed_cost as profit,
         case when unit > 0 then greatest(1, cast(round_even(fixed_cost / unit, 0) as bigint)) else 999999 end as bep
  from ordered)"""


@query(
    f"""with {_BREAK_EVEN} select store_id, segment_name, channel, offer_type, target_customers,
    {sql.exact('open_rate', 4)} as expected_open_rate, {sql.exact('conversion', 4)} as expected_conversion_rate,
    orders as expected_incremental_orders, {sql.exact('orders * basket', 2)} as expected_incremental_revenue,
    {sql.exact('profit', 2)} as expected_incremental_profit, cast(bep as bigint) as break_even_orders,
    {sql.exact('bep * basket', 2)} as break_even_revenue,
    {sql.exact('least(0.99, greatest(0.01, orders / bep))', 4)} as break_even_probability,
    case when fixed_cost > 0 then {sql.exact('profit / fixed_cost * 100', 2)} else 0.0 end as expected_roi,
    {sql.exact('least(0.93, greatest(0.55, 0.62 + least(recent_visit_count, 1000) / 4000 + least(target_customers, 3000) / 12000))', 4)} as confidence
    from judged"""
)
def campaign_break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = campaigns.campaign_break_even(b.campaign_plans(spark, sf_dir))
    return rows.select(
        "store_id", "segment_name", "channel", "offer_type", "target_customers", "expected_incremental_orders",
        "break_even_orders", *campaigns.BREAK_EVEN_DECIMALS,
    )


@query(
    f"""with {_BREAK_EVEN} select store_id, segment_name, channel, offer_type,
    format('{{}} 세그먼트 {{:,}}명 대상 {{}} 캠페인은 예상 전환율 {{:.1f}}%로 손익분기 {{:,}}건 대비 {{:,}}건의 증분 주문이 기대됩니다.',
           segment_name, target_customers, channel, conversion * 100, cast(bep as bigint), orders) as summary,
    case when least(0.99, greatest(0.01, orders / bep)) < 0.8 then '{fv.BREAK_EVEN_ADVICE_LOW}'
         else '{fv.BREAK_EVEN_ADVICE_OK}' end as advice
    from judged"""
)
def campaign_break_even_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = insights.break_even_strategy(b.campaign_plans(spark, sf_dir))
    return rows.select(
        "store_id", "segment_name", "channel", "offer_type", "summary", F.element_at("action_guide", -1).alias("advice")
    )


_UPLIFT = f"""{sql.PLANS}, redeemed as (
    select *, (store_id % 6) * 0.1::double as discount_rate from plans),
    rated as (
      select *, least(0.32, greatest(0.02,
        cast(case segment_name when 'champions' then 0.07 when 'loyal' then 0.09 when 'at_risk' then 0.11
             when 'lost' then 0.05 else 0.07 end as double)
        * cast(case channel when 'sms' then 1.03 when 'push' then 0.94 else 1.08 end as double)
        * least(1.35, 0.95 + discount_rate * 2.4) * greatest(0.75, least(1.2, 0.85 + return_rate * 1.4)))) as redemption
      from redeemed),
    ordered as (select *, cast(round_even(target_customers * redemption, 0) as bigint) as orders from rated),
    valued as (
      select *, {sql.exact('orders * avg_order_value * greatest(0.82, 1 - discount_rate * 0.6)', 2)} as revenue,
        least(1.5, greatest(0.03, orders / greatest(1, round_even(recent_visit_count / 7, 0)))) as uplift,
        0.63 + least(recent_visit_count, 700) / 3500 + least(target_customers, 3000) / 15000 as certainty
      from ordered)"""


@query(
    f"""with {_UPLIFT} select store_id, segment_name, channel, target_customers,
    {sql.exact('redemption', 4)} as expected_redemption_rate, orders as expected_incremental_orders,
    {sql.exact('uplift', 4)} as expected_uplift_rate, revenue as expected_incremental_revenue,
    {sql.exact('least(0.92, greatest(0.58, certainty))', 4)} as confidence from valued"""
)
def campaign_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = campaigns.campaign_uplift(b.uplift_plans(spark, sf_dir))
    return rows.select(
        "store_id", "segment_name", "channel", "target_customers", "expected_incremental_orders",
        "expected_incremental_revenue", *campaigns.UPLIFT_DECIMALS,
    )


@query(
    f"""with {_UPLIFT} select store_id, segment_name, channel,
    format('추가 주문 {{:,}}건, 추가 매출 {{:,}}원 수준을 기대합니다.', orders, cast(round_even(revenue, 0) as bigint))
      as order_guide,
    format('예상 리딤률은 {{:.1f}}%입니다.', redemption * 100) as redemption_guide from valued"""
)
def campaign_uplift_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = insights.uplift_strategy(b.uplift_plans(spark, sf_dir))
    guide = F.col("action_guide")
    return rows.select(
        "store_id", "segment_name", "channel", guide[1].alias("order_guide"), guide[0].alias("redemption_guide")
    )


@query(f"with {sql.TARGETS} select campaign_id, customer_id, reason from judged where reason is not null")
def target_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.target_exclusions(b.campaign_targets(spark, sf_dir))


@query(
    f"""with {sql.TARGETS} select campaign_id, customer_id from judged j where not exists (
    select 1 from judged x where x.reason is not null and x.campaign_id = j.campaign_id
      and x.customer_id = j.customer_id)"""
)
def valid_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.valid_targets(b.campaign_targets(spark, sf_dir)).select("campaign_id", "customer_id")


@query(
    f"""with {sql.TARGETS}, excluded as (select distinct campaign_id, customer_id from judged where reason is not null)
    select j.campaign_id, count(*) filter (e.customer_id is null) as valid_count,
      count(*) filter (reason is not null) as excluded_count
    from judged j left join excluded e on j.campaign_id = e.campaign_id and j.customer_id = e.customer_id
    group by j.campaign_id"""
)
def target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.target_summary(b.campaign_targets(spark, sf_dir))


@query(
    """with campaigns as (
      select concat(c_mktsegment, '-', c_nationkey) as campaign_id, c_nationkey % 3 <> 0 as approved,
        count(*) as valid_target_count, ['coupon', 'point', 'sms'][c_nationkey % 3 + 1] as channel,
        c_nationkey % 2 = 0 as dry_run
      from customer group by c_mktsegment, c_nationkey)
    select *, case when not approved then 'pending_approval' when dry_run then 'scheduled' else 'executed' end as status,
      0 as retries,
      case when not approved then '승인 전 단계이므로 실행이 보류되었습니다.'
           when dry_run then concat(channel, ' 채널 발송이 dry-run으로 검증되었습니다.')
           else concat(valid_target_count, '건 발송을 실행 큐에 적재했습니다.') end as message
    from campaigns"""
)
def campaign_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.campaign_handoff(b.campaigns(spark, sf_dir))


# --- text -------------------------------------------------------------------------------------


@query(f"select doc_id, md5({sql.masked('text')}) as masked_digest, {sql.masked('text')} <> text as changed from documents")
def pii_masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = b.table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("original"))
    return notices.mask_pii(documents, "text").select(
        "doc_id", F.md5("text").alias("masked_digest"), (F.col("text") != F.col("original")).alias("changed")
    )


@query(
    "select doc_id, "
    + " or ".join(f"contains(lower(text), '{w}')" for w in (*fv.BLOCKED_TERMS, *b.POLICY_WORDS))
    + " as policy_violation from documents"
)
def policy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    return notices.policy_flags(documents, "text", (*fv.BLOCKED_TERMS, *b.POLICY_WORDS)).drop("text")


@query(
    f"""with {sql.NOTICE_LINES}, short as (
    select doc_id, source, length(text) as size, case when len(lines) > 0
      then left(array_to_string(lines[1:2], ' '), 180) else '{fv.EMPTY_NOTICE}' end as summary from noticed)
    select doc_id, {sql.masked('summary')} as summary,
      {' or '.join(f"contains(lower({sql.masked('summary')}), '{w}')" for w in fv.BLOCKED_TERMS)} as policy_violation, cast(0.95 as double) as ocr_confidence,
      concat(size, '자') as text_size, 'ocr-rule-0.1.0' as model_version from short"""
)
def notice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.notice_summary(b.notices(spark, sf_dir), policy="flag").select(
        "doc_id", "summary", "policy_violation", "ocr_confidence", F.col("evidence")[0]["value"].alias("text_size"), "version.model_version"
    )


@query(
    f"""with {sql.NOTICE_LINES}, marked as (
    select doc_id, lines, list_filter(lines, lambda l: {' or '.join(f"contains(l, '{w}')" for w in b.NOTICE_WORDS)})
      as required from noticed),
    chosen as (select doc_id, case when len(required) > 0 then required else lines[1:1] end as items from marked),
    placed as (select doc_id, items, unnest(range(len(items))) as position from chosen)
    select doc_id, cast(position as integer) as position, items[position + 1] as item, '확인 필요' as deadline,
      'store_owner' as assignee from placed"""
)
def notice_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.notice_checklist(b.notices(spark, sf_dir), ("doc_id",), b.NOTICE_WORDS)


@query(
    """with terms as (
      select distinct unnest(string_split_regex(lower(text), '[^a-z]+')) as term from benchmark),
    texts as (select doc_id, lower(text) as text from documents)
    select doc_id, count(*) filter (length(term) % 3 = 0) as n0, count(*) filter (length(term) % 3 = 1) as n1,
      count(*) filter (length(term) % 3 = 2) as n2
    from texts left join terms on term <> '' and contains(text, term) group by doc_id"""
)
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct terms of a lexicon table every document holds, by group, in one pass over the texts."""
    texts = b.table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    found = lexicon.term_hits(texts, "text", b.benchmark_lexicon(spark, sf_dir))
    return found.select("doc_id", *(F.coalesce(F.try_element_at("hits", F.lit(g)), F.lit(0)).alias(g) for g in ("n0", "n1", "n2")))


# --- data quality -----------------------------------------------------------------------------


@query(
    """with grouped as (
      select c_nationkey as store_id, cast(date_trunc('month', o_orderdate) as date) as month,
        cast(min(o_orderdate) as date) as window_start, cast(max(o_orderdate) as date) as window_end,
        count(*) as record_count
      from orders join customer on o_custkey = c_custkey group by all),
    sized as (select *, cast(window_end - window_start + 1 as integer) as day_count from grouped)
    select *, concat_ws('|',
        case when day_count < 14 then concat('최소 14일 데이터가 필요하지만 ', day_count, '일만 제공되었습니다.') end,
        case when record_count < 10 then concat('최소 10건 데이터가 필요하지만 ', record_count, '건만 제공되었습니다.') end)
      as warnings, day_count < 14 or record_count < 10 as cold_start
    from sized"""
)
def data_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.store_days(spark, sf_dir).withColumn("month", F.trunc("visit_date", "month"))
    checked = sufficiency.data_sufficiency(rows, ("store_id", "month"), "visit_date", min_records=10, weight="records")
    return checked.withColumn("warnings", F.concat_ws("|", F.col("warnings.message")))


def _profile_sql(dataset: str, source: str, column: str, numeric: bool, key: bool) -> str:
    value = f"try_cast({column} as double)"
    spread = (
        f"count({value}) as value_count, coalesce(min({value}), 0.0) as min_value, coalesce(max({value}), 0.0) as max_value, "
        f"coalesce(round(avg({value}), 4), 0.0) as mean_value"
        if numeric
        else "cast(null as bigint) as value_count, cast(null as double) as min_value, cast(null as double) as max_value, "
        "cast(null as double) as mean_value"
    )
    missing = f"count(*) filter (trim(coalesce({column}, '')) = '')" if key else "cast(null as bigint)"
    return (
        f"select '{dataset}' as dataset_type, count(*) as row_count, '{column}' as column_name, {spread}, "
        f"{missing} as missing_count from {source}"
    )


_RAW_REVIEWS = """raw_reviews as (
  select concat(conv_id, '-', turn) as review_id, role as store_id,
         case when role = 'system' then ' ' else cast(turn as varchar) end as rating, text as review_text,
         case role when 'user' then 'negative' when 'assistant' then 'positive' end as sentiment_label
  from conversations)"""
_RAW_SALES = f"""{sql.SALES_DAILY},
raw_sales as (select cast(columns(*) as varchar) from sales_daily)"""
_PROFILED = [
    ("review", "raw_reviews", "rating", True, True),
    ("review", "raw_reviews", "review_id", False, True),
    ("review", "raw_reviews", "store_id", False, True),
    ("review", "raw_reviews", "review_text", False, True),
    ("sales", "raw_sales", "revenue", True, True),
    ("sales", "raw_sales", "orders", True, False),
    ("sales", "raw_sales", "customers", True, True),
    ("sales", "raw_sales", "avg_ticket", True, True),
    ("sales", "raw_sales", "promo_flag", True, False),
    ("sales", "raw_sales", "date", False, True),
    ("sales", "raw_sales", "store_id", False, True),
]


@query(f"with {_RAW_REVIEWS}, {_RAW_SALES} " + " union all ".join(_profile_sql(*entry) for entry in _PROFILED))
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_all({"review": b.raw_reviews(spark, sf_dir), "sales": b.raw_sales(spark, sf_dir)})


@query(
    """select cast(p_partkey as varchar) as menu_id, p_brand as store_id, cast(trunc(p_retailprice) as integer) as price,
    round(p_retailprice * 0.5, 2) as cost, cast(p_size as double) as quantity, cast(0.5 as double) as margin_rate,
    p_type as category, 'part' as source_name from part"""
)
def normalize_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize(b.raw_menu(spark, sf_dir), "menu").drop("uploaded_at")


@query(
    f"""with {_RAW_REVIEWS} select review_id, store_id, try_cast(rating as integer) as rating, sentiment_label,
      concat_ws('|', case when trim(rating) = '' then 'missing:rating' end,
                case when regexp_replace(review_text, '[{sql.SPACE}]+', '', 'g') = '' then 'missing:review_text' end,
                case when sentiment_label is null then 'missing:sentiment_label' end) as reasons
    from raw_reviews"""
)
def quarantine_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.normalize(b.raw_reviews(spark, sf_dir), "review", mode="quarantine")
    return rows.select("review_id", "store_id", "rating", "sentiment_label", joined("reasons"))


@query(
    """select cast(c_custkey as varchar) as customer_id, case when c_custkey % 19 <> 0 then cast(c_nationkey as varchar) end as store_id,
    case when c_custkey % 17 <> 0 then cast(c_custkey % 90 as double) end as recency, cast(c_custkey % 12 as double) as frequency,
    c_acctbal as monetary, case when c_custkey % 23 <> 0 then cast(c_custkey % 90 as double) end as last_visit_days,
    cast((c_custkey % 5) * 0.25 as double) as coupon_use_rate, cast(c_custkey % 2 as integer) as churned,
    concat_ws('|', case when c_custkey % 19 = 0 then 'missing:store_id' end, case when c_custkey % 17 = 0 then 'invalid:recency' end,
              case when c_custkey % 23 = 0 then 'invalid:last_visit_days' end) as reasons from customer"""
)
def quarantine_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.normalize(b.raw_customers(spark, sf_dir), "customer", mode="quarantine")
    return rows.drop("source_name", "uploaded_at").withColumn("reasons", F.concat_ws("|", "reasons"))


@query(
    """select cast(event_id as varchar) as event_id, cast(user_id as varchar) as store_id, event_type, value as amount,
    case when event_id % 11 <> 0 then concat('E', user_id % 7) end as employee_id,
    cast(floor(epoch(ts)) as bigint) as event_seconds, cast(event_type = 'error' as integer) as is_anomaly,
    case when event_id % 11 = 0 then 'missing:employee_id' else '' end as reasons from events"""
)
def quarantine_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.normalize(b.raw_anomalies(spark, sf_dir), "anomaly", mode="quarantine")
    return rows.withColumns({"event_seconds": F.unix_timestamp("event_time"), "reasons": F.concat_ws("|", "reasons")}).drop(
        "event_time", "source_name", "uploaded_at"
    )


@query(
    f"""with {sql.STOCK} select month, 'all' as store_id, cast(item_id as varchar) as item_id, system_qty, actual_qty,
    round(loss_rate, 6) as loss_rate from reordered"""
)
def normalize_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.normalize(b.raw_inventory(spark, sf_dir), "inventory").drop("source_name", "uploaded_at")
    return rounded(rows, 6, "loss_rate")


@query(f"with {sql.staffing()} select date, store_id, hour, sales, staff_actual, staff_recommended from staffed")
def normalize_staffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize(b.raw_staffing(spark, sf_dir), "staffing").drop("source_name", "uploaded_at")


@query(
    f"""with {sql.PLANS} select store_id, segment_name, channel, concat_ws('|',
      case when target_customers < 1 then 'target_customers' end,
      case when (store_id % 6) * 0.3 > 1 then 'discount_rate' end) as violations from plans"""
)
def expectation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = b.uplift_plans(spark, sf_dir).withColumn("discount_rate", F.col("discount_rate") * 3)
    checked = expectations.expect_record(plans, "campaign_uplift_plan")
    return checked.select("store_id", "segment_name", "channel", joined("violations"))


@query(records.checks_sql())
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All record types: valid and rejected rows written apart in one pass each, counted from the written tables and on the way."""
    parts = []
    for record in expectations.RECORD_RULES:
        found = expectations.split_records(records.records(spark, sf_dir, record), record, new_path(spark, f"records-{record}"))
        valid = found.valid.agg(F.count("*").alias("valid_rows"))
        rejected = found.rejected.agg(F.count("*").alias("rejected_rows"))
        broken = "|".join(f"{name}:{n}" for name, n in found.broken.items())
        row = attach(valid, rejected).withColumns(
            {"record": F.lit(record), "row_count": F.lit(found.counts["rows"]).cast("bigint"), "broken": F.lit(broken)}
        )
        parts.append(row.select("record", "row_count", "valid_rows", "rejected_rows", "broken"))
    return reduce(DataFrame.unionByName, parts)


# --- sources and sinks ------------------------------------------------------------------------


@query(
    f"""with {sql.SALES_DAILY} select store_id, count(*) as row_count, {sql.money('revenue')} as revenue,
    sum(customers) as customers, min(date) as first_date, cast(sum(promo_flag) as bigint) as promo_rows
    from (select cast(store_id as varchar) as store_id, * exclude (store_id) from sales_daily) group by store_id"""
)
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sales-csv")
    b.raw_sales(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    rows = normalize.normalize(read_raw(spark, "sales", path), "sales")
    return rows.groupBy("store_id").agg(
        F.count("*").alias("row_count"),
        F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("revenue"),
        F.sum("customers").alias("customers"),
        F.min("date").alias("first_date"),
        F.sum("promo_flag").alias("promo_rows"),
    )


@query(
    """select source, source = 'src3' as is_broken,
    case when source <> 'src3' then cast(sum(n_lines) as bigint) end as notice_lines,
    case when source <> 'src3' then cast(sum(n_chars) as bigint) end as notice_chars, cast(sum(n_bytes) as bigint) as notice_bytes
    from (select source, length(replace(text, chr(13), '')) + 1 as n_chars,
            length(text) - length(replace(text, chr(10), '')) + 1 as n_lines, strlen(replace(text, chr(13), '')) + if(source = 'src3', 2, 1) as n_bytes
          from documents where source is not null and text is not null)
    group by source"""
)
def notice_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files of their source, one source with broken bytes; decoded strictly, broken files kept apart."""
    path = new_path(spark, "notice-files")
    text = F.replace("text", F.lit("\r"), F.lit(""))
    broken = F.concat(F.unhex(F.lit("FF")), text.cast("binary")).cast("string")
    lines = b.table(spark, sf_dir, "documents").where("source is not null and text is not null")
    lines.select(F.when(F.col("source") == "src3", broken).otherwise(text).alias("value"), "source").write.partitionBy("source").text(path)
    files = read_notices(spark, path, broken="keep")
    is_broken = F.col("corrupt_file").isNotNull()
    return files.groupBy("source").agg(
        F.bool_or(is_broken).alias("is_broken"),
        F.sum(F.length("notice_text") - F.length(F.replace("notice_text", F.lit("\n"), F.lit("")))).alias("notice_lines"),
        F.sum(F.length("notice_text")).alias("notice_chars"),
        F.sum(F.octet_length(F.coalesce(F.col("notice_text").cast("binary"), "corrupt_file"))).alias("notice_bytes"),
    )


@query(f"with {sql.cancels()} select {_SLOT_COLUMNS} from scored")
def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "receipts-json")
    lines = b.receipts(spark, sf_dir).select(
        F.col("receipt_no").cast("string").alias("receipt_no"),
        F.col("store_id").cast("string").alias("store_key"),
        "sales_date", "sales_time", "total_amount", "status",
    )
    write_table(lines, path, file_format="json")
    return rounded(risk.cancel_anomalies(read_feed(spark, "receipts", path)), 6, "cancel_rate", "anomaly_score")


@query(
    f"""with {sql.CUSTOMER_RFM}, {sql.EVENTS_SCORED}, {sql.REVIEWS}, best as (
      select is_anomaly from events_scored order by anomaly_probability desc, event_id limit 2)
    select 'review_sentiment' as task, 'run-1' as version, 'accuracy' as metric_name,
      round(avg(case when sentiment_label = sentiment then 1.0 else 0.0 end), 4) as metric_value,
      count(*) as sample_size from rated where sentiment_label is not null
    union all select 'churn', 'run-1', 'accuracy_proxy',
      round(avg(case when (case when churned = 1 then 'high' else 'low' end)
        = (case when risk_level = 'medium' then 'high' else risk_level end) then 1.0 else 0.0 end), 4), count(*)
      from churn_rated
    union all select 'anomaly', 'run-1', 'precision_at_2', (select round(avg(is_anomaly), 4) from best),
      (select count(*) from events)"""
)
def metric_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluate, add the metrics of a run to an empty log, load the log."""
    path = new_path(spark, "metrics")
    labelled = b.with_labels(spark, sf_dir, b.reviews(spark, sf_dir)).filter(F.col("sentiment_label").isNotNull())
    found = quality.evaluate(
        labelled,
        b.customer_rfm(spark, sf_dir),
        b.anomaly_events(spark, sf_dir),
        "run-1",
        positive=b.POSITIVE_WORDS,
        negative=b.NEGATIVE_WORDS,
    )
    found = stored(found, "run-metrics")
    # Written twice, as by a job that is run again: the log has each metric once.
    for _ in range(2):
        append_metrics(found, path, "run-1")
    return load_metrics(spark, path).drop("created_at", "run")


@query(
    f"""with {sql.REVIEWS} select 'review_baseline' as task, count(*) as row_count,
    round(avg(case when sentiment_label = sentiment then 1.0 else 0.0 end), 4) as accuracy, count(*) as sample_size
    from rated where sentiment_label is not null"""
)
def scoring_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the scored reviews and return the run's summary."""
    path = new_path(spark, "review-scores")
    labelled = _rated(spark, sf_dir).filter(F.col("sentiment_label").isNotNull())
    return write_scores(
        "review_baseline", labelled, path, lambda rows: quality.accuracy(rows, "sentiment_label", "sentiment")
    )


@query(
    """select 'menu_strategy_baseline' as task, count(*) as row_count from part"""
)
def scoring_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the menu table as CSV, score the files, return the run's summary."""
    path = new_path(spark, "menu-csv")
    b.raw_menu(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    return jobs.score(spark, "menu", path, new_path(spark, "menu-scores"))


# --- combined reports -------------------------------------------------------------------------


@query(
    f"""with {sql.VISITS}, {sql.FIGURES}, {_DIAGNOSED}, {_CHURN_INPUT.split(sql.VISITS + ',', 1)[1]},
    {sql.staffing("cast(user_id % 25 as integer)")}, first_hours as (
      select store_id, arg_min(recommendation, epoch(date) / 3600 + hour) as advice, cast(count(*) as integer) as hours
      from staffed group by store_id)
    select d.store_id, concat_ws(' ', {_SALES_TEXT},
      printf('이탈 위험 고객은 %s명이며 방문 지연은 평균 주기의 %.1f배입니다. 위험도는 %s로 판단되며 현재 쿠폰 반응률 기준 예상 방어율은 %.1f%%입니다.',
           format('{{:,}}', at_risk_customers), cycle_ratio, risk_band, save_rate * 100),
      format('프로모션 ROI는 42.1%이고 평균 객단가는 {{:,}}원입니다.', cast(round_even(avg_order_value, 0) as bigint)),
      coalesce(advice, '{fv.STORE_NO_STAFFING}')) as summary,
      concat_ws('|', split_part(lines, '|', 1), split_part(lines, '|', 2), format('이탈 위험 고객 {{:,}}명', at_risk_customers),
        printf('방문 지연 %.1f일, 평균 주기 %.1f일', delayed_visit_days, avg_visit_cycle_days),
        coalesce(advice, format('최근 방문 {{:,}}건 기준으로 재방문 고객 액션 우선순위를 점검하세요.', recent_visit_count)))
        as priority_actions, coalesce(hours, 0) as staffing_rows
    from diagnosed d join saved s on d.store_id = s.store_id left join figures f on d.store_id = f.store_id
    left join first_hours h on d.store_id = h.store_id"""
)
def store_intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.store_intelligence(
        b.stores(spark, sf_dir),
        b.sales_changes_input(spark, sf_dir),
        b.churn_input(spark, sf_dir),
        b.store_staffing(spark, sf_dir),
    )
    return rows.select("store_id", "summary", joined("priority_actions"), F.size("staffing").alias("staffing_rows"))


_PLAN_TEXTS = {
    "churn": f"""with {_CHURN_INPUT} select store_id, 1 as place,
      printf('이탈 위험 고객은 %s명이며 방문 지연은 평균 주기의 %.1f배입니다. 위험도는 %s로 판단되며 현재 쿠폰 반응률 기준 예상 방어율은 %.1f%%입니다.',
             format('{{:,}}', at_risk_customers), cycle_ratio, risk_band, save_rate * 100) as line from saved""",
    "retention": f"""with {sql.RETENTION} select store_id, row_number() over (partition by store_id order by segment_name) as place,
      format('{{}} 세그먼트 {{}}명에게 {{:,}}원 수준 복귀 오퍼를 제안합니다.', segment_name, customer_count, cast(discount as bigint)) as line from offers""",
    "anomaly": f"""with {_ANOMALY_INPUT} select store_id, 1 as place,
      format('payment 이상이 {{}}건 감지됐고 이상 점수는 {{:.1f}}점입니다. 예상 매출 영향은 {{:,}}원이며 대응 우선순위는 {{}}입니다.',
             occurrence_count, anomaly_score, cast(round_even(revenue_impact, 0) as bigint), severity) as line from anomaly_rated""",
    "menu": f"""with menu_rows as (
        select p_partkey as menu_id, s_nationkey as store_id, cast(trunc(p_retailprice) as integer) as price,
          sum(l_quantity) as quantity, 1 - (0.3 + p_size / 100) as margin_rate
        from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey
        group by p_partkey, s_nationkey, p_retailprice, p_size), {sql.priced()}
      select store_id, row_number() over (partition by store_id order by menu_id) as place,
        format('메뉴 {{}}는 현재 마진율 {{}}% 기준으로 `{{}}` 전략이 적합하며 권장 가격 범위는 {{:,}}원~{{:,}}원입니다.', menu_id,
               printf('%.1f', margin_rate * 100), action, recommended_price_min, recommended_price_max) as line from priced""",
    "staffing": f"""with {sql.staffing("cast(user_id % 25 as integer)")}
      select store_id, row_number() over (partition by store_id order by date, hour) as place, recommendation as line from staffed""",
    "inventory": f"""with {sql.STOCK.replace("strftime(l_shipdate, '%Y-%m') as month", "s_nationkey as month").replace("from lineitem", "from lineitem join supplier on l_suppkey = s_suppkey")}
      select month as store_id, row_number() over (partition by month order by item_id) as place,
        case risk_level when 'high' then '{fv.INVENTORY_ADVICE["high"]}' when 'medium' then '{fv.INVENTORY_ADVICE["medium"]}'
          else '{fv.INVENTORY_ADVICE["low"]}' end as line from reordered""",
}


def _plan_text_sql() -> str:
    """One CTE per part: the lines of the first 20 rows, sorted, and a count of the others."""
    return ", ".join(
        f"""{part}_lines as ({lines}), {part} as (
      select store_id, string_agg(line, chr(10) order by line) filter (place <= 20)
        || case when count(*) > 20 then chr(10) || format('외 {{:,}}건', count(*) - 20) else '' end as {part}
      from {part}_lines group by store_id)"""
        for part, lines in _PLAN_TEXTS.items()
    )


@query(
    f"""with {_plan_text_sql()}, scenarios as (
      select n_nationkey as store_id, unnest(['retention_recovery', 'anomaly_followup', 'operations_tuning']) as scenario
      from nation),
    known as (
      select s.store_id, s.scenario, scenario = 'retention_recovery' as recover, scenario = 'anomaly_followup' as follow,
        case when scenario = 'retention_recovery' then churn when scenario = 'anomaly_followup' then anomaly end as analysis,
        case when scenario = 'retention_recovery' then retention end as strategy,
        case when scenario = 'operations_tuning' then menu end as menu_strategy,
        case when scenario = 'operations_tuning' then staffing end as staffing,
        case when scenario = 'operations_tuning' then inventory end as inventory
      from scenarios s left join churn using (store_id) left join retention using (store_id) left join anomaly using (store_id)
        left join menu using (store_id) left join staffing using (store_id) left join inventory using (store_id)),
    planned as (
      select *, case when recover and strategy is not null then '{fv.HANDOFF_MESSAGES["pending_approval"]}'
                     when follow then '{fv.PLAN_ANOMALY_OUTPUT}' end as execution from known)
    select store_id, scenario, case when execution is not null then 'pending_approval' else 'completed' end as status,
      concat_ws('|', case when analysis is not null then 'analysis:completed' end,
        case when strategy is not null or menu_strategy is not null then 'strategy:completed' when follow then 'strategy:skipped' end,
        case when execution is not null then 'execution:pending_approval' end,
        case when staffing is not null then 'staffing:completed' end,
        case when inventory is not null then 'inventory:completed' end) as steps,
      analysis, strategy, execution, menu_strategy, staffing, inventory from planned"""
)
def action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.action_plan(b.action_requests(spark, sf_dir), **b.action_inputs(spark, sf_dir))
    steps = F.transform("steps", lambda step: F.concat_ws(":", step["name"], step["status"]))
    outputs = ("analysis", "strategy", "execution", "menu_strategy", "staffing", "inventory")
    return rows.select(
        "store_id", "scenario", "status", F.concat_ws("|", steps).alias("steps"),
        *(F.try_element_at("outputs", F.lit(name)).alias(name) for name in outputs),
    )


@query(
    f"""with {sql.SEGMENTS}, {sql.hourly()}, {sql.menus()}, {sql.cancels()}
    select round(max(anomaly_score), 2) as risk_score,
      (select concat_ws('|', count(*) filter (category = 'Star'), count(*) filter (category = 'Plowhorse'),
         count(*) filter (category = 'Puzzle'), count(*) filter (category = 'Dog')) from quadrants) as menu_counts,
      (select concat_ws('|', count(*) filter (segment = 'VIP'), count(*) filter (segment = 'At Risk'),
         count(*) filter (segment = 'Lost'), count(*) filter (segment = 'New'), count(*) filter (segment = 'Loyal'))
       from segments) as customer_counts,
      (select concat('오늘의 주요 피크 타임은 ', string_agg(cast(hour as varchar), ', ' order by hour) filter (is_peak),
        '시이며, ', arg_max(hour, sum_revenue), '시에 최대 매출이 발생했습니다.') from trend) as sales_summary,
      '{fv.DASHBOARD_TEXT["headline"]}' as headline, '{fv.DASHBOARD_TEXT["reasoning"]}' as reasoning,
      '{fv.DASHBOARD_TEXT["action_item"]}' as action_item
    from scored"""
)
def dashboard_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = reports.dashboard(
        b.hourly_sales(spark, sf_dir),
        b.lineup(spark, sf_dir),
        b.visits(spark, sf_dir),
        b.receipts(spark, sf_dir),
        menu_sales=b.menu_sales(spark, sf_dir),
    )
    menus = [F.col(f"menu_summary.{name}_count") for name in ("star", "plowhorse", "puzzle", "dog")]
    customers = [F.col(f"churn_summary.{name}_count") for name in ("vip", "at_risk", "lost", "new", "loyal")]
    return tables["overview"].select(
        "risk_score",
        F.concat_ws("|", *[count.cast("string") for count in menus]).alias("menu_counts"),
        F.concat_ws("|", *[count.cast("string") for count in customers]).alias("customer_counts"),
        "sales_summary",
        *fv.DASHBOARD_TEXT,
    )
