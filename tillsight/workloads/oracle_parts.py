"""SQL pieces shared by the comparison queries."""

from __future__ import annotations

from tillsight import fixed_values as fv
from tillsight.workloads import bridges as b


def money(column: str) -> str:
    return f"cast(sum(cast({column} as decimal(18,2))) as double)"


def exact(expression: str, places: int) -> str:
    """Rounding on the exact binary value, halves to even."""
    return f"cast(printf('%.{places}f', cast({expression} as double)) as double)"


VISITS = """visits as (
  select o_custkey as customer_id, c_nationkey as store_id, cast(o_orderdate as date) as visit_date,
         o_totalprice as payment_amount
  from orders join customer on o_custkey = c_custkey)"""

TIMED_VISITS = """visits as (
  select user_id as customer_id, ts as visit_date, value as payment_amount from events)"""


def rfm(keys: str = "", by_date: bool = True) -> str:
    """CTEs from `visits` to `rfm`; `keys` is a column list ending in a comma."""
    on = "true" if not keys else "s.store_id = i.store_id"
    if by_date:
        gap = "visit_date - lag(visit_date) over w"
        recency = "latest - last_visit"
    else:
        gap = "floor((epoch_us(visit_date) - lag(epoch_us(visit_date)) over w) / 86400000000)"
        recency = "floor((epoch_us(latest) - epoch_us(last_visit)) / 86400000000)"
    group = "" if not keys else "group by store_id"
    return f"""gaps as (
  select {keys} customer_id, visit_date, payment_amount, {gap} as gap
  from visits window w as (partition by {keys} customer_id order by visit_date)),
intervals as (
  select {keys} customer_id, max(visit_date) as last_visit, count(*) as frequency,
         {money('payment_amount')} as monetary, avg(gap) as own_interval
  from gaps group by {keys} customer_id),
overall as (
  select {keys} avg(own_interval) as mean_interval, max(last_visit) as latest from intervals {group}),
filled as (
  select i.*, cast({recency} as integer) as recency,
         coalesce(own_interval, mean_interval, 30.0) as avg_interval
  from intervals i join overall s on {on}),
rfm as (
  select {keys} customer_id, recency, frequency, monetary, avg_interval,
         case when avg_interval = 0 then case when recency > 0 then 1.0 when recency < 0 then 0.0 end
              else greatest(0.0, least(recency / (avg_interval * 1.5), 1.0)) end as churn_probability
  from filled)"""


def segments(keys: str = "") -> str:
    on = "true" if not keys else "r.store_id = m.store_id"
    group = "" if not keys else "group by store_id"
    return f"""medians as (select {keys} median(monetary) as middle from rfm {group}),
segments as (
  select r.*, case when churn_probability > 0.8 then 'At Risk' when recency > 90 then 'Lost'
                   when frequency >= 5 and monetary >= middle then 'VIP'
                   when frequency >= 2 then 'Loyal' else 'New' end as segment
  from rfm r join medians m on {on})"""


RFM = f"{VISITS},\n{rfm()}"
SEGMENTS = f"{RFM},\n{segments()}"

CUSTOMER_RFM = f"""{RFM},
shares as (
  select l_orderkey, count(*) filter (l_discount > 0.05) / count(*) as share from lineitem group by l_orderkey),
coupons as (
  select o_custkey, coalesce(avg(share), 0.0) as coupon_use_rate
  from orders left join shares on o_orderkey = l_orderkey group by o_custkey),
customer_rfm as (
  select rfm.*, c_nationkey as store_id, coalesce(coupon_use_rate, 0.0) as coupon_use_rate,
         case when coalesce(churn_probability, 0.0) > 0.8 then 1 else 0 end as churned
  from rfm left join coupons on customer_id = o_custkey left join customer on customer_id = c_custkey),
churn_scored as (
  select *, {exact("""least(recency / 60.0, 1.0) * 50 + greatest(0.0, 1.0 - frequency / 10.0) * 30
                  + (1.0 - coupon_use_rate) * 20""", 2)} as churn_score from customer_rfm),
churn_rated as (
  select *, case when churn_score >= 65 then 'high' when churn_score >= 40 then 'medium' else 'low' end as risk_level
  from churn_scored)"""

SALES_DAILY = f"""daily as (
  select c_nationkey as store_id, cast(date_trunc('month', o_orderdate) as date) as date,
         {money('o_totalprice')} as revenue, cast(count(*) as double) as orders,
         cast(count(distinct o_custkey) as double) as customers,
         max(case when o_orderpriority like '1%' then 1 else 0 end) as promo_flag
  from orders join customer on o_custkey = c_custkey group by all),
sales_daily as (select *, revenue / orders as avg_ticket from daily)"""

SALES_CHANGES = f"""{SALES_DAILY},
edges as (
  select store_id, min(date) as window_start, max(date) as window_end, count(*) as record_count,
         sum(promo_flag) / count(*) as promo_share,
         arg_min(revenue, date) as r0, arg_max(revenue, date) as r1,
         arg_min(customers, date) as c0, arg_max(customers, date) as c1,
         arg_min(avg_ticket, date) as t0, arg_max(avg_ticket, date) as t1,
         arg_min(orders, date) as o0, arg_max(orders, date) as o1
  from sales_daily group by store_id),
changes as (
  select store_id, window_start, window_end, record_count, promo_share,
         case when r0 = 0 then 0.0 else (r1 - r0) / r0 * 100 end as revenue_delta_pct,
         case when c0 = 0 then 0.0 else (c1 - c0) / c0 * 100 end as customer_delta_pct,
         case when t0 = 0 then 0.0 else (t1 - t0) / t0 * 100 end as avg_ticket_delta_pct,
         case when o0 = 0 then 0.0 else (o1 - o0) / o0 * 100 end as channel_delta_pct
  from edges)"""


def hourly(keys: str = "") -> str:
    return f"""hours as (
  select {keys} cast(hour(ts) as integer) as hour, {money('value')} / count(value) as mean_revenue,
         {money('value')} as sum_revenue, count(value) as sale_count
  from (select *, user_id as store_id from events) where event_type = 'purchase' group by {keys} hour(ts)),
trend as (
  select *, avg(sum_revenue) over (partition by {keys} 1 order by hour rows between 1 preceding and 1 following)
           as moving_avg,
         sum_revenue >= quantile_cont(sum_revenue, 0.8) over (partition by {keys} 1) as is_peak
  from hours)"""


def menus(keys: str = "") -> str:
    on = "true" if not keys else "j.store_id = t.store_id"
    group = "" if not keys else "group by store_id"
    return f"""sold as (
  select {keys} l_partkey, sum(l_quantity) as qty
  from (select *, l_suppkey as store_id from lineitem) group by {keys} l_partkey),
joined as (
  select {keys} p_partkey as menu_name, qty, p_retailprice as sales_price,
         p_retailprice * (0.3 + p_size / 100) as cost_price,
         p_retailprice - p_retailprice * (0.3 + p_size / 100) as unit_margin
  from sold join part on l_partkey = p_partkey),
totals as (
  select {keys} sum(qty) as total_qty, count(*) as menus,
         cast(sum(cast(unit_margin as decimal(18,4))) as double) / count(unit_margin) as mean_margin
  from joined {group}),
metrics as (
  select j.*, unit_margin * qty as total_margin, menus,
         case when total_qty <> 0 then qty / total_qty end as popularity_index,
         case when mean_margin <> 0 then unit_margin / mean_margin end as profitability_index
  from joined j join totals t on {on}),
sides as (
  select *, coalesce(popularity_index >= (1 / menus) * 0.7, false) as popular,
         coalesce(profitability_index >= 1.0, unit_margin > 0, false) as profitable from metrics),
quadrants as (
  select *, case when popular and profitable then 'Star' when popular then 'Plowhorse'
                 when profitable then 'Puzzle' else 'Dog' end as category from sides)"""


MENU_ROWS = """menu_rows as (
  select p_partkey as menu_id, store_id, cast(trunc(p_retailprice) as integer) as price,
         p_retailprice * (0.3 + p_size / 100) as cost, quantity, 1 - (0.3 + p_size / 100) as margin_rate
  from (select l_partkey, cast(year(l_shipdate) as integer) as store_id, sum(l_quantity) as quantity
        from lineitem group by all) join part on l_partkey = p_partkey)"""


def priced(source: str = "menu_rows") -> str:
    return f"""signalled as (
  select *, case when margin_rate < 0.25 then 'raise_price'
                 when margin_rate > 0.55 and quantity < 50 then 'lower_price'
                 when margin_rate < 0.40 and quantity > 200 then 'raise_price' else 'hold' end as pricing_signal
  from {source}),
priced as (
  select *, case when pricing_signal = 'raise_price' then 'price_up_test'
                 when margin_rate < 0.20 then 'cost_review'
                 when quantity > 300 and margin_rate < 0.35 then 'bundle_promotion' else 'maintain' end as action,
         cast(trunc(price * case pricing_signal when 'raise_price' then cast(1.05 as double)
              when 'lower_price' then cast(0.90 as double) else cast(1.0 as double) end) as bigint)
           as recommended_price_min,
         cast(trunc(price * case pricing_signal when 'raise_price' then cast(1.15 as double)
              when 'lower_price' then cast(0.98 as double) else cast(1.05 as double) end) as bigint)
           as recommended_price_max
  from signalled)"""


def cancels(keys: str = "") -> str:
    on = "true" if not keys else "s.store_id = t.store_id"
    group = "" if not keys else "group by store_id"
    return f"""receipts as (
  select event_id as receipt_no, user_id as store_id, cast(ts as date) as sales_date,
         cast(hour(ts) as integer) as hour, value as total_amount,
         case when event_type = 'error' then 'cancelled' else 'completed' end as status from events),
slots as (
  select {keys} sales_date, hour, count(receipt_no) as total_count,
         count(*) filter (status = 'cancelled') as cancel_count,
         count(*) filter (status = 'cancelled') / count(receipt_no) as cancel_rate
  from receipts group by {keys} sales_date, hour),
spread as (select {keys} avg(cancel_rate) as mean, stddev_samp(cancel_rate) as std from slots {group}),
scored as (
  select s.*, case when std > 0 then (cancel_rate - mean) / std else 0.0 end as anomaly_score
  from slots s join spread t on {on})"""


HIGH_VALUE = """risky as (
  select r.* from receipts r
  join (select cast(sum(cast(total_amount as decimal(18,2))) as double) / count(total_amount) as mean from receipts) m
    on true
  where status = 'cancelled' and total_amount > mean * 3)"""

EVENTS_SCORED = f"""grouped as (
  select event_type, count(*) as n, avg(value) as mean, stddev_pop(value) as std from events
  where event_type is not null and value is not null group by event_type),
events_scored as (
  select event_id, user_id as store_id, e.event_type, value as amount,
         case when e.event_type = 'error' then 1 else 0 end as is_anomaly,
         case when value is null or n is null then null when n < 2 then 0.5 when std = 0 then 0.0
              else {exact('least(abs((value - mean) / std) / 3.0, 1.0)', 4)} end as anomaly_probability
  from events e left join grouped g on e.event_type = g.event_type)"""


def hits(words, column: str = "lowered") -> str:
    return " + ".join(f"cast(contains({column}, '{w}') as integer)" for w in words)


REVIEWS = f"""reviews as (
  select d.doc_id as review_id, source as store_id, lower(text) as lowered,
         case when quality = 1 then 'positive' when quality = 0 then 'negative' end as sentiment_label
  from documents d left join labels l on d.doc_id = l.doc_id),
counted as (
  select *, {hits(b.POSITIVE_WORDS)} as liked, {hits(b.NEGATIVE_WORDS)} as disliked from reviews),
rated as (
  select review_id, store_id, sentiment_label,
         case when liked > disliked then 'positive' when disliked > liked then 'negative' else 'neutral' end
           as sentiment,
         cast(case when liked <> disliked then round(0.55 + least(greatest(liked, disliked) * 0.1, 0.35), 2)
              else 0.55 end as double) as confidence
  from counted)"""


def staffing(store: str = "'all'") -> str:
    return f"""staffing as (
  select {store} as store_id, cast(ts as date) as date, cast(hour(ts) as integer) as hour,
         {money('value')} as sales,
         cast(count(*) filter (event_type in ('view', 'click')) as integer) as staff_actual,
         cast(count(*) filter (event_type in ('purchase', 'signup')) as integer) as staff_recommended
  from events group by all),
gapped as (select *, staff_recommended - staff_actual as gap from staffing),
staffed as (
  select *, case when gap >= 1 then 'understaffed' when gap <= -1 then 'overstaffed' else 'balanced' end as status,
         case when gap <= 0 then 0 else cast(trunc((sales * 0.08) * gap) as bigint) end as opportunity_cost,
         case when gap >= 1 then concat(gap, '명 추가 투입 또는 피크타임 재배치 권고')
              when gap <= -1 then concat(abs(gap), '명 재배치 또는 조기 종료 검토')
              else '{fv.STAFFING_ADVICE["balanced"]}' end as recommendation
  from gapped)"""


STOCK = f"""stock as (
  select strftime(l_shipdate, '%Y-%m') as month, l_suppkey as item_id, sum(l_quantity) as system_qty,
         sum(case when l_returnflag = 'R' and l_discount >= 0.07 then 0.0 else l_quantity end) as actual_qty
  from lineitem group by all),
lossy as (
  select *, (system_qty - actual_qty) / system_qty as loss_rate,
         greatest(cast(trunc(system_qty - actual_qty) as bigint), 0) as short,
         cast(trunc(system_qty * 0.1) as bigint) as safety from stock),
reordered as (
  select *, case when loss_rate >= 0.10 then 'high' when loss_rate >= 0.06 then 'medium' else 'low' end as risk_level,
         case when loss_rate >= 0.10 then short + safety
              when loss_rate >= 0.06 then short + cast(trunc(safety * 0.5) as bigint)
              else greatest(short, cast(trunc(system_qty * 0.05) as bigint)) end as reorder_qty,
         cast(trunc((system_qty - actual_qty) * 1000) as bigint) as estimated_loss_amount
  from lossy)"""

STORE_SEGMENTS = f"""{SEGMENTS},
store_segments as (
  select c_nationkey as store_id, segment, count(*) as customer_count, {money('monetary')} as revenue,
         cast(sum(frequency) as bigint) as visit_count
  from segments join customer on customer_id = c_custkey group by all)"""

RETENTION = f"""{STORE_SEGMENTS},
retention as (
  select store_id, segment as segment_name, customer_count,
         round(revenue * 0.1 / customer_count, 2) as avg_margin_per_customer,
         case segment when 'At Risk' then 'high' when 'Lost' then 'medium' else 'low' end as churn_risk_level,
         cast((store_id % 5) * 20000 as bigint) as coupon_budget
  from store_segments),
offers as (
  select *, case when coupon_budget <> 0 and customer_count > 0
                 then least(full_discount, greatest(coupon_budget // customer_count, 500)) else full_discount end
              as discount,
         avg_margin_per_customer * customer_count * expected_return as expected_revenue
  from (select *,
          cast(case churn_risk_level when 'high' then 3000 when 'medium' then 2000 else 1000 end as bigint)
            as full_discount,
          cast(case churn_risk_level when 'high' then 0.18 when 'medium' then 0.11 else 0.06 end as double)
            as expected_return
        from retention))"""

FIGURES = """per_customer as (
  select store_id, customer_id, count(*) as orders,
         count(*) filter (visit_date > (select max(visit_date) from visits) - 90) as recent,
         sum(cast(payment_amount as decimal(18,2))) as spent
  from visits group by all),
figures as (
  select store_id, round(cast(sum(spent) as double) / sum(orders), 2) as avg_order_value,
         cast(sum(recent) as bigint) as recent_visit_count,
         round(count(*) filter (orders >= 2) / count(*), 4) as return_rate
  from per_customer group by store_id)"""

PLANS = f"""{STORE_SEGMENTS},
{FIGURES},
plans as (
  select s.store_id,
         case segment when 'VIP' then 'champions' when 'Loyal' then 'loyal' when 'At Risk' then 'at_risk'
              when 'Lost' then 'lost' else 'new' end as segment_name,
         customer_count as target_customers, avg_order_value, recent_visit_count, return_rate,
         cast(42.1 as double) as roi_rate, unnest(['sms', 'push', 'kakao']) as channel
  from store_segments s join figures f on s.store_id = f.store_id)"""

TARGETS = f"""{RFM},
targets as (
  select c_mktsegment as campaign_id, c_custkey as customer_id, c_acctbal >= 0 as consent,
         coalesce(recency, 0) % 15 as cooldown_days, c_custkey % 50 = 0 as duplicate
  from customer left join rfm on c_custkey = customer_id),
judged as (
  select *, case when not consent then 'missing_consent' when cooldown_days < 7 then 'cooldown_active'
                 when duplicate then 'duplicate_target' end as reason from targets)"""

# Unicode white space and line breaks, spelled out for engines with ASCII classes.
SPACE = r"\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BREAK = r"\r\n|[\n\x0b\x0c\r\x{85}\x{2028}\x{2029}\x1c-\x1e]"

NOTICE_LINES = f"""noticed as (
  select doc_id, text, source, list_filter(list_transform(regexp_split_to_array(text, '{BREAK}'),
           lambda l: regexp_replace(regexp_replace(l, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')),
           lambda l: l <> '') as lines
  from documents)"""


def masked(column: str) -> str:
    """Masking with Unicode word boundaries, written as explicit neighbours."""
    phone = rf"regexp_replace({column}, '(\d{{2,3}})-(\d{{3,4}})-(\d{{4}})', '\1-****-\3', 'g')"
    mail = rf"regexp_replace({phone}, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b', '***@***', 'g')"
    return rf"regexp_replace({mail}, '\b\d{{6}}-\d{{7}}\b', '******-*******', 'g')"
