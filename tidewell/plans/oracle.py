"""Independent DuckDB statements for every query of ``plans.registry``.

They run on the same Parquet tables (registered as views under their own
names) and must give the same rows, names and types.  Numbers use plain ``sum``,
``avg`` and ``round``; money sums are rounded to cents on both sides, as sums of
floats depend on their order in the last bits.
"""

from __future__ import annotations


def FIX(x: str, d: int) -> str:
    return f"round(cast({x} as double), {d})"


def EXSUM(x: str) -> str:
    return f"round(cast(sum({x}) as double), 2)"


def EXMEAN(x: str) -> str:
    return f"avg({x})"


AQI_CASE = """case when {m} <= 50 then 'Good' when {m} <= 100 then 'Moderate'
        when {m} <= 150 then 'Unhealthy for Sensitive Groups' when {m} <= 200 then 'Unhealthy'
        when {m} <= 300 then 'Very Unhealthy' else 'Hazardous' end"""

WORST = f"""
with daily as (
    select user_id, event_type, cast(ts as date) as day, {EXMEAN('value')} as m
    from events group by 1, 2, 3
), b as (
    select user_id, event_type, day, {FIX('m', 0)} as reading, {AQI_CASE.format(m='m')} as band
    from daily
), w as (
    select *, row_number() over (partition by user_id, day
                                 order by reading desc, event_type asc) as rn
    from b
)"""

MONTH = "cast(date_trunc('month', cast({c} as date)) as date)"

SQL: dict[str, str] = {}

SQL["band_days"] = WORST + """
select band, count(*) as day_count,
       case band when 'Good' then 1 when 'Moderate' then 2
                 when 'Unhealthy for Sensitive Groups' then 3 when 'Unhealthy' then 4
                 when 'Very Unhealthy' then 5 when 'Hazardous' then 6 end as severity
from w where rn = 1 group by band"""

SQL["worst_days"] = WORST + """
select user_id, day, event_type, reading as max_reading, band
from w where rn = 1 order by max_reading desc, user_id, day limit 15"""

SQL["freq_type"] = """
select event_type, count(*) as event_count from events
where event_type is not null group by event_type"""

SQL["freq_default"] = """
select coalesce(nullif(trim(regexp_extract(p_name, '^(small|large|new|old) ', 1)), ''), 'Unknown')
       as size_word, count(*) as part_count
from part group by 1"""

SQL["month_rollup"] = f"""
select {MONTH.format(c='o_orderdate')} as order_month, count(*) as order_count,
       {EXSUM('o_totalprice')} as total_price, {FIX(EXMEAN('o_totalprice'), 2)} as avg_price
from orders where o_orderdate is not null group by 1"""

SQL["month_refresh"] = f"""
select {MONTH.format(c='o_orderdate')} as order_month, count(*) as order_count,
       {EXSUM('o_totalprice')} as total_price
from orders where o_orderdate is not null group by 1"""

SQL["year_rollup"] = f"""
select cast(year(l_shipdate) as integer) as ship_year, {EXSUM('l_extendedprice')} as total_price,
       count(*) filter (where l_discount > 0.05) as discounted_lines,
       {FIX(EXMEAN('l_quantity'), 4)} as avg_quantity
from lineitem where l_shipdate is not null group by 1"""

SQL["month_normals"] = f"""
select cast(month(o_orderdate) as integer) as month_num,
       {FIX(EXMEAN('o_totalprice'), 2)} as avg_price, count(*) as order_count,
       strftime(make_date(2000, cast(month(o_orderdate) as integer), 1), '%b') as month_name
from orders where o_orderdate is not null group by 1"""

MONTHLY = f"""
with monthly as (
    select {MONTH.format(c='o_orderdate')} as month,
           sum(cast(o_totalprice as decimal(18,2))) as total
    from orders where o_orderdate is not null group by 1
)"""

SQL["seasonal"] = MONTHLY + f"""
select cast(month(month) as integer) as month_of_year,
       sign(sum(total)) * ((2 * abs(cast(sum(total) * 100 as hugeint)) + count(total))
                           // (2 * count(total))) / 100.0 as avg_monthly_total, count(*) as years
from monthly group by 1"""

SQL["annual_complete"] = MONTHLY + """
select cast(year(month) as integer) as year, cast(sum(total) as double) as total_price,
       count(*) as months_reported
from monthly group by 1 having count(*) = 12"""

SQL["fiscal_peak"] = """
select cast(case when month(o_orderdate) >= 10 then year(o_orderdate) + 1
                 else year(o_orderdate) end as integer) as fiscal_year,
       max(o_totalprice) as peak_price
from orders group by 1"""

SQL["hour_weekday"] = """
select dayname(ts) as weekday, cast(hour(ts) as integer) as hour_of_day, count(*) as event_count
from events where ts is not null group by 1, 2"""

SQL["collapse_lines"] = """
select l_orderkey, max(l_quantity) as max_quantity,
       count(nullif(l_returnflag, 'N')) as flagged_lines, count(*) as line_count
from lineitem group by l_orderkey"""

SQL["group_having"] = f"""
select o_custkey, count(*) as order_count, {FIX(EXMEAN('o_totalprice'), 1)} as avg_price,
       {EXSUM('o_totalprice')} as total_price
from orders group by o_custkey having count(*) >= 3"""

SQL["summary_row"] = """
select count(*) as total_lines, count(distinct l_partkey) as distinct_parts,
       count(distinct l_suppkey) as distinct_suppliers,
       cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as returned_lines,
       cast(sum(case when l_linestatus = 'F' then 1 else 0 end) as bigint) as finished_lines
from lineitem"""

SQL["distincts_by_group"] = """
select l_linestatus, count(distinct l_orderkey) as orders, count(distinct l_partkey) as parts,
       count(distinct cast(l_shipdate as date)) as ship_days, count(distinct l_returnflag) as flags,
       count(distinct l_discount) as discounts,
       count(distinct l_partkey) filter (where l_returnflag = 'R') as returned_parts,
       count(*) as line_count
from lineitem group by 1"""

SQL["pct_guarded"] = f"""
select o_orderpriority, count(*) as order_count,
       {FIX("cast(count(*) filter (where o_orderstatus in ('F', 'O')) as double) * 100.0 / nullif(cast(count(*) as double), 0.0)", 2)}
           as pct_closed_or_open
from orders group by 1"""

SQL["span"] = f"""
select min({MONTH.format(c='o_orderdate')}) as first_month,
       max({MONTH.format(c='o_orderdate')}) as last_month,
       count(distinct {MONTH.format(c='o_orderdate')}) as month_count
from orders"""

SQL["site_means"] = f"""
select user_id, {FIX(EXMEAN('value'), 4)} as avg_value, {FIX(EXMEAN('value'), 0)} as avg_value_rounded,
       max(value) as max_value, count(*) as event_count
from events group by user_id"""

SQL["trend_line"] = f"""
with yearly as (
    select cast(cast(year(o_orderdate) as integer) as double) as x, {EXMEAN('o_totalprice')} as y
    from orders where o_orderdate is not null group by year(o_orderdate)
)
select {FIX('regr_slope(y, x)', 4)} as slope, {FIX('regr_intercept(y, x)', 4)} as intercept,
       {FIX('regr_r2(y, x)', 4)} as r2, cast(regr_count(y, x) as bigint) as n_points
from yearly"""

SQL["first_last_change"] = MONTHLY + f""", m as (select month, cast(total as double) as total from monthly),
agg as (
    select arg_min(total, month) as first_total, arg_max(total, month) as last_total,
           max(total) as peak_total,
           cast(sum(cast(total as decimal(18,2))) as double) as all_total
    from m
), peak as (select month as peak_month from m order by total desc, month asc limit 1)
select first_total, last_total, {FIX('last_total - first_total', 2)} as change,
       {FIX('last_total / nullif(first_total, 0.0)', 4)} as growth_ratio, peak_month,
       {FIX('peak_total * 100.0 / all_total', 4)} as peak_share_pct
from agg, peak"""

SQL["typed_projection"] = """
with k as (
    select event_id, regexp_extract(props, '"k":\\s*([^,}]*)', 1) as k,
           cast(value / 2 as varchar) as half, cast(ts as varchar) as ts_text
    from events
)
select event_id, try_cast(k as integer) as k_int, try_cast(k as double) as k_double,
       try_cast(k || '.0' as bigint) as k_bigint, try_cast(half as integer) as half_int,
       try_cast(k || 'x' as integer) as bad_int,
       cast(try_cast(ts_text as timestamp) as date) as event_date,
       try_cast(left(ts_text, 10) as date) as prefix_date
from k where try_cast(k as integer) is not null"""

SQL["compact_date"] = """
with s as (
    select o_orderkey,
           case when o_orderkey % 7 = 0 then '' when o_orderkey % 11 = 0 then 'garbage'
                else strftime(o_orderdate, '%Y%m%d') end as date_text
    from orders
)
select o_orderkey, date_text, cast(try_strptime(nullif(date_text, ''), '%Y%m%d') as date) as parsed_date,
       (nullif(trim(date_text), '') is not null
        and try_strptime(nullif(date_text, ''), '%Y%m%d') is null) as unparsed
from s"""

SQL["epoch_date"] = """
with s as (select o_orderkey, epoch_ms(o_orderdate) as epoch_ms from orders)
select o_orderkey, epoch_ms,
       case when make_timestamp(epoch_ms * 1000) >= timestamp '1997-01-01'
            then cast(make_timestamp(epoch_ms * 1000) as date) end as order_date
from s"""

SQL["parts_date"] = """
select o_orderkey,
       case when month(o_orderdate) between 1 and 12
            then make_date(cast(year(o_orderdate) as integer), cast(month(o_orderdate) as integer), 1)
       end as month_date,
       case when month(o_orderdate) + 6 between 1 and 12
            then make_date(cast(year(o_orderdate) as integer), cast(month(o_orderdate) + 6 as integer), 1)
       end as shifted_date
from orders"""

SQL["unit_convert"] = f"""
select l_orderkey, l_linenumber,
       {FIX('l_quantity / 10.0 / 25.4', 6)} as qty_in,
       {FIX('l_quantity / 10.0 * 9 / 5 + 32', 6)} as qty_f,
       {FIX('l_extendedprice / 43560.0', 6)} as price_acres,
       {FIX('sqrt(greatest(least(l_quantity * 7.0, 300.0), 1.0)) * 40', 6)} as radius
from lineitem"""

SQL["flag_yn"] = """
with f as (select nullif(l_returnflag, 'N') = 'R' as is_returned from lineitem)
select is_returned, count(*) as line_count,
       count(*) filter (where is_returned) as where_true,
       count(*) filter (where not is_returned) as where_false
from f group by 1"""

SQL["code_label"] = """
with o as (
    select case when coalesce(lower(split_part(o_orderpriority, '-', -1)), '') = '' then 'Unknown'
                else coalesce(case upper(regexp_replace(lower(split_part(o_orderpriority, '-', -1)), '^\\s+|\\s+$', '', 'g'))
                                  when 'URGENT' then 'Urgent' when 'HIGH' then 'High'
                                  when 'LOW' then 'Low' end,
                              upper(regexp_replace(lower(split_part(o_orderpriority, '-', -1)), '^\\s+|\\s+$', '', 'g'))) end
               as priority_label,
           o_orderstatus
    from orders
), s(status_code, status_label) as (
    values ('F', 'Fulfilled'), ('O', 'Open'), ('X', 'Cancelled')
)
select priority_label, status_label, count(*) as order_count
from o left join s on o.o_orderstatus = s.status_code
group by 1, 2"""

SQL["keyword_flag"] = """
select p_partkey, coalesce(regexp_matches(p_name, '(?i)\\b(ring|bolt|old)'), false) as has_keyword
from part"""

SQL["first_token"] = """
with t as (
    select p_partkey, p_name, string_split_regex(regexp_replace(p_name, '^\\s+|\\s+$', '', 'g'), '\\s+') as toks from part
), f as (
    select p_partkey, p_name,
           case when lower(toks[1]) in ('small') and len(toks) > 1 then toks[2] else toks[1] end as tok
    from t
)
select p_partkey,
       case when tok is null or lower(tok) in ('hot', '') then null
            else upper(substr(tok, 1, 1)) || lower(substr(tok, 2)) end as first_word,
       array_to_string(list_transform(string_split(lower(p_name), ' '),
                                      lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') as title
from f"""

SQL["size_bands"] = """
with b as (
    select case when p_retailprice < 920 then 'Budget (<920)'
                when p_retailprice < 940 then 'Value (920-940)'
                when p_retailprice < 960 then 'Mid (940-960)'
                when p_retailprice < 980 then 'Premium (960-980)'
                else 'Luxury (980+)' end as size_band,
           case when p_retailprice < 920 then 1 when p_retailprice < 940 then 2
                when p_retailprice < 960 then 3 when p_retailprice < 980 then 4 else 5 end as sort_order
    from part
)
select size_band, sort_order, count(*) as part_count from b group by 1, 2"""

SQL["relabel"] = f"""
select case when c_mktsegment = 'BUILDING' then 'Building' else 'Other' end as segment_group,
       {EXSUM('c_acctbal')} as total_balance, count(*) as customer_count
from customer group by 1"""

SQL["box_filter"] = """
select l_orderkey, l_linenumber, l_discount, l_tax from lineitem
where l_orderkey is not null and l_discount between 0.02 and 0.06 and l_tax between 0.01 and 0.05"""

SQL["search_text"] = """
with d as (
    select doc_id, n_chars,
           (coalesce(contains(lower(text), 'water'), false)
            or coalesce(contains(lower(source), 'water'), false)) as text_hit,
           source like 'src1%' as prefix_hit
    from documents
)
select doc_id, n_chars, text_hit, prefix_hit from d where text_hit or prefix_hit"""

SQL["date_window"] = """
select o_orderkey, cast(o_orderdate as date) as order_date, o_orderpriority from orders
where o_orderdate >= timestamp '1996-01-01' and o_orderdate <= timestamp '1997-12-31'
  and o_orderpriority in ('1-URGENT', '2-HIGH')"""

SQL["recent_window"] = """
with o as (
    select o_orderkey, cast(o_orderdate as date) as order_date,
           cast(case when month(o_orderdate) >= 10 then year(o_orderdate) + 1
                     else year(o_orderdate) end as integer) as fiscal_year
    from orders
)
select o_orderkey, order_date, fiscal_year,
       fiscal_year >= (select max(fiscal_year) from o) - 2 as in_last_3_fiscal
from o
where order_date >= (select cast(max(order_date) - interval 2 year as date) from o)"""

SQL["scalar_cols"] = """
select timestamp '2024-02-15 00:00:00' as built_at,
       (select count(*) from region) as region_rows,
       (select count(*) from nation) as nation_rows,
       (select count(*) from customer) as customer_rows,
       (select count(*) from supplier) as supplier_rows,
       (select count(*) from part) as part_rows,
       cast((select count(*) from region) + (select count(*) from nation)
            + (select count(*) from customer) + (select count(*) from supplier)
            + (select count(*) from part) as bigint) as total_records"""

SQL["orphans"] = """
select l_orderkey, count(*) as line_count from lineitem l
where l_orderkey is not null and not exists (
    select 1 from orders o where o.o_orderkey = l.l_orderkey
                             and o.o_orderdate < timestamp '2000-01-01')
group by l_orderkey"""

SQL["top_rows"] = """
select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 15"""

SQL["top_groups"] = """
select l_suppkey, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) as double) as revenue
from lineitem group by l_suppkey order by revenue desc, l_suppkey limit 8"""

SQL["records"] = """
with d as (select cast(l_shipdate as date) as ship_date, l_quantity, l_extendedprice, l_discount, l_tax
           from lineitem),
r1 as (select 1 as sort_order, 'Largest quantity' as record_type, ship_date,
              cast(cast(round(l_quantity, 0) as integer) as varchar) || ' units' as value
       from d where l_quantity is not null order by l_quantity desc, ship_date limit 1),
r2 as (select 2, 'Cheapest line', ship_date, cast(round(l_extendedprice, 2) as varchar) || ' USD'
       from d where l_extendedprice is not null order by l_extendedprice asc, ship_date limit 1),
r3 as (select 3, 'Deepest discount', ship_date, cast(round(l_discount * 100.0, 1) as varchar) || ' %'
       from d where l_discount is not null order by l_discount desc, ship_date limit 1),
r4 as (select 4, 'Highest tax', ship_date, cast(round(l_tax, 2) as varchar)
       from d where l_tax is not null order by l_tax desc, ship_date limit 1)
select record_type, ship_date, value from (
    select * from r1 union all select * from r2 union all select * from r3
    union all select * from r4)"""

SQL["sample_rows"] = """
select event_id, user_id, event_type, value from events
order by md5(cast(event_id as varchar) || '42'), event_id limit 1000"""

SQL["cell_top"] = """
with c as (select user_id, event_type, count(*) as event_count from events
           where event_type is not null group by 1, 2),
r as (select *, row_number() over (partition by user_id order by event_count desc, event_type)
                as type_rank from c)
select user_id, event_type, event_count, type_rank from r where type_rank <= 3"""


def _hex_cells(points_sql: str, extra: str = "") -> str:
    """CTEs ending in ``cell`` (hex_q, hex_r plus ``extra`` columns) for the
    points of ``points_sql`` (columns lon, lat plus extras)."""
    import math
    lon0, lat0, radius = -122.33, 47.61, 250.0
    kx = 111320.0 * math.cos(math.radians(lat0)) / radius
    ky = 110540.0 / radius
    s3 = math.sqrt(3.0)
    d = lambda v: f"cast({v!r} as double)"
    ex = (", " + extra) if extra else ""
    return f"""
with p as ({points_sql}
), a as (
    select (lon - {d(lon0)}) * {d(kx)} as x, (lat - {d(lat0)}) * {d(ky)} as y{ex} from p
), f as (
    select x * {d(s3 / 3.0)} - y * {d(1.0 / 3.0)} as fq, y * {d(2.0 / 3.0)} as fr{ex} from a
), g as (
    select fq, fr, 0.0 - fq - fr as fs{ex} from f
), rr as (
    select fq, fr, fs, floor(fq + 0.5) as rq, floor(fr + 0.5) as rr_, floor(fs + 0.5) as rs{ex} from g
), dd as (
    select *, abs(rq - fq) as dq, abs(rr_ - fr) as dr, abs(rs - fs) as ds from rr
), cell as (
    select cast(case when dq > dr and dq > ds then 0.0 - rr_ - rs else rq end as bigint) as hex_q,
           cast(case when not (dq > dr and dq > ds) and dr > ds then 0.0 - rq - rs else rr_ end as bigint) as hex_r{ex}
    from dd
)"""


def _hex_sql() -> str:
    import math
    lon0, lat0, radius = -122.33, 47.61, 250.0
    kx = 111320.0 * math.cos(math.radians(lat0)) / radius
    ky = 110540.0 / radius
    s3 = math.sqrt(3.0)
    d = lambda v: f"cast({v!r} as double)"
    cells = _hex_cells("""
    select -122.45 + l_quantity / 200.0 as lon, 47.5 + l_extendedprice / 1000000.0 as lat
    from lineitem""")
    return cells + f""", c as (select hex_q, hex_r, count(*) as point_count from cell group by 1, 2)
select hex_q, hex_r, point_count,
       {FIX(f"(cast(hex_q as double) * {d(s3)} + cast(hex_r as double) * {d(s3 / 2.0)}) / {d(kx)} + {d(lon0)}", 6)} as center_lon,
       {FIX(f"(cast(hex_r as double) * 1.5) / {d(ky)} + {d(lat0)}", 6)} as center_lat
from c"""


_EVENT_POINTS = """
    select event_id, event_type, -122.45 + value / 2000.0 as lon, 47.5 + user_id / 1000.0 as lat
    from events where value is not null and user_id is not null"""

SQL["hex_top_types"] = _hex_cells(_EVENT_POINTS, "event_id, event_type") + """, c as (
    select hex_q, hex_r, event_type, count(*) as category_count from cell
    where event_type is not null group by 1, 2, 3
), r as (
    select *, row_number() over (partition by hex_q, hex_r
                                 order by category_count desc, event_type) as category_rank
    from c
)
select hex_q, hex_r, event_type, category_count, category_rank from r where category_rank <= 8"""

SQL["hex_sample_rows"] = _hex_cells(_EVENT_POINTS, "event_id, event_type") + """, r as (
    select hex_q, hex_r, event_id, event_type,
           row_number() over (partition by hex_q, hex_r
                              order by md5(cast(event_id as varchar) || '42'), event_id) as rn
    from cell
)
select hex_q, hex_r, event_id, event_type from r where rn <= 12"""

SQL["hex_bins"] = _hex_sql()

SQL["cell_samples"] = """
with r as (
    select user_id, event_id, event_type, value,
           row_number() over (partition by user_id
                              order by md5(cast(event_id as varchar) || '42'), event_id) as rn
    from events
)
select user_id, event_id, event_type, value from r where rn <= 12"""

SQL["recovery"] = MONTHLY + f""", m as (select month, cast(total as double) as total from monthly)
select arg_max(total, month) as latest_total,
       max(total) filter (where month < date '2000-03-01') as peak_before,
       {FIX('arg_max(total, month) / nullif(max(total) filter (where month < date ' + "'2000-03-01'" + '), 0.0)', 4)} as recovery_ratio,
       {FIX('arg_max(total, month) * 100.0 / cast(sum(cast(total as decimal(18,2))) as double)', 4)} as latest_share_pct
from m"""

SQL["dq_report"] = """
select * , case when failures = 0 then 'pass' else severity end as status from (
  select 'lineitem' as table_name, 'not_null' as check_name, 'l_orderkey' as column_name,
         cast(count(*) filter (where l_orderkey is null) as bigint) as failures, 'error' as severity from lineitem
  union all select 'lineitem', 'not_null', 'l_shipdate',
         count(*) filter (where l_shipdate is null), 'error' from lineitem
  union all select 'orders', 'unique', 'o_orderkey',
         (select count(*) from (select o_orderkey from orders where o_orderkey is not null
                                group by 1 having count(*) > 1)), 'error'
  union all select 'orders', 'accepted_values', 'o_orderstatus',
         count(*) filter (where o_orderstatus is not null and o_orderstatus not in ('F', 'O', 'P')), 'error' from orders
  union all select 'lineitem', 'accepted_values', 'l_returnflag',
         count(*) filter (where l_returnflag is not null and l_returnflag not in ('A', 'N')), 'warn' from lineitem
  union all select 'lineitem', 'accepted_range', 'l_discount',
         count(*) filter (where l_discount < 0.0 or l_discount > 0.1), 'error' from lineitem
  union all select 'lineitem', 'accepted_range', 'l_quantity',
         count(*) filter (where l_quantity < 1.0 or l_quantity > 49.0), 'warn' from lineitem
  union all select 'lineitem', 'unique_combination', 'l_orderkey,l_linenumber',
         (select count(*) from (select l_orderkey, l_linenumber from lineitem
                                group by 1, 2 having count(*) > 1)), 'warn'
  union all select 'lineitem', 'relationships', 'l_orderkey',
         (select count(*) from lineitem l where l_orderkey is not null and not exists
             (select 1 from orders o where o.o_orderkey = l.l_orderkey)), 'error'
)"""

SQL["freshness"] = """
with f as (
    select 'orders' as feed, cast(max(o_orderdate) as timestamp) as newest, 30 as w, 90 as e from orders
    union all select 'lineitem', cast(max(l_shipdate) as timestamp), 14, 45 from lineitem
    union all select 'events', cast(max(ts) as timestamp), 14, 45 from events
), g as (
    select *, (epoch(timestamp '2024-02-15 00:00:00') - epoch(newest)) / 3600.0 as hours from f
)
select feed, cast(newest as date) as newest_date, cast(floor(hours / 24) as integer) as age_days,
       case when newest is null or hours > e * 24 then 'error'
            when hours > w * 24 then 'warn' else 'pass' end as status
from g"""

SQL["parse_failures"] = """
with t as (
    select case when o_orderkey % 7 = 0 then '' when o_orderkey % 11 = 0 then 'garbage'
                else strftime(o_orderdate, '%Y%m%d') end as start_text,
           case when o_orderkey % 13 = 0 then 'n/a' else cast(o_totalprice as varchar) end as price_text,
           case when o_orderkey % 5 = 0 then ' ' else cast(o_custkey as varchar) end as cust_text
    from orders
)
select 'orders_text' as table_name, 'start_text' as column_name, 'compact_date' as parsed_as,
       count(*) filter (where nullif(trim(start_text), '') is not null) as non_blank,
       count(*) filter (where nullif(trim(start_text), '') is not null
                          and try_strptime(nullif(start_text, ''), '%Y%m%d') is null) as unparsed
from t
union all
select 'orders_text', 'price_text', 'double',
       count(*) filter (where nullif(trim(price_text), '') is not null),
       count(*) filter (where nullif(trim(price_text), '') is not null and try_cast(price_text as double) is null)
from t
union all
select 'orders_text', 'cust_text', 'bigint',
       count(*) filter (where nullif(trim(cust_text), '') is not null),
       count(*) filter (where nullif(trim(cust_text), '') is not null and try_cast(cust_text as bigint) is null)
from t"""

SQL["sql_view"] = """
select o_orderpriority, count(*) as order_count from orders
group by o_orderpriority order by order_count desc, o_orderpriority"""

SQL["metric_table"] = """
select * from (
  select 'total_orders' as metric_name, 'Orders' as label, 'Orders on record.' as description,
         'count' as unit, (select cast(count(*) as double) from orders) as value
  union all select 'total_order_value', 'Order value', 'Summed order price.', 'usd',
         (select cast(sum(cast(o_totalprice as decimal(18,2))) as double) from orders)
  union all select 'pct_urgent_orders', 'Urgent share', 'Share of orders marked ''1-URGENT''.', 'percent',
         (select cast(round(100.0 * count(*) filter (where o_orderpriority = '1-URGENT')
                            / nullif(count(*), 0)) as double) from orders)
  union all select 'total_quantity', 'Units', 'Units shipped.', 'count',
         (select cast(sum(l_quantity) as double) from lineitem)
  union all select 'discounted_lines', 'Discounted lines', 'Lines with a discount above 5 %.', 'count',
         (select cast(count(*) filter (where l_discount > 0.05) as double) from lineitem)
  union all select 'max_customer_balance', 'Top balance', 'Largest customer account balance.', 'usd',
         (select cast(max(c_acctbal) as double) from customer)
) order by metric_name"""


def _audit_sql() -> str:
    from tidewell.plans.registry import STATEMENT_TEMPLATES
    from tidewell.operators.audit import FORBIDDEN_ANYWHERE

    def q(s):
        return "'" + s.replace("'", "''") + "'"
    vals = ",\n        ".join(f"({i}, {q(e)}, {q(t)})" for i, (e, t) in enumerate(STATEMENT_TEMPLATES))
    words = "[" + ", ".join(q(w) for w in FORBIDDEN_ANYWHERE) + "]"
    return f"""
with t(template_id, expected, template) as (
    values {vals}
), s as (
    select o_orderkey, template_id, expected,
           replace(template, '{{k}}', cast(o_orderkey as varchar)) as sql
    from orders join t on t.template_id = cast(o_orderkey % {len(STATEMENT_TEMPLATES)} as integer)
), c as (
    select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                  sql, '--[^\\n]*|(?s:/\\*.*?\\*/)', ' ', 'g'),
                  '\\A\\s+|\\s+\\z', '', 'g'), ';\\z', ''), '\\A\\s+|\\s+\\z', '', 'g') as body
    from s
), j as (
    select *, list_sort(list_intersect(regexp_extract_all(lower(body), '\\b([a-z_]+)\\b', 1), {words})) as bad
    from c
), r as (
    select *, case when body = '' then 'empty' when contains(body, ';') then 'several statements'
                   when not regexp_matches(body, '(?i)\\A(select|with)') then 'not a query'
                   when len(bad) > 0 then 'forbidden: ' || array_to_string(bad, ', ') end as refused_for
    from j
)
select o_orderkey, template_id, expected, refused_for, refused_for is null as is_read_only,
       case when refused_for is null then body end as cleaned_sql
from r"""


SQL["statement_audit"] = _audit_sql()

SQL["nested_flatten"] = f"""
with p as (
    select p_partkey, p_name, cast(p_size as bigint) as size,
           -122.3 + cast(p_size as double) / 1000.0 as lon, 47.6 + p_retailprice / 100000.0 as lat
    from part
)
select p_partkey, p_name as name, size,
       {FIX('((((0.0 + lon) + (lon + 0.001)) + (lon + 0.001)) + lon) / 4', 6)} as lon,
       {FIX('((((0.0 + lat) + lat) + (lat + 0.001)) + (lat + 0.001)) / 4', 6)} as lat
from p"""

SQL["nested_series"] = """
select l_orderkey, l_linenumber, 'flow' as kind, strftime(cast(l_shipdate as date), '%Y-%m-%d') as period,
       cast(l_quantity as varchar) as value from lineitem
union all
select l_orderkey, l_linenumber, 'flow', strftime(cast(l_shipdate as date) + 1, '%Y-%m-%d'),
       cast(l_tax as varchar) from lineitem
union all
select l_orderkey, l_linenumber, 'tide', cast(year(l_shipdate) as varchar) || '-' || cast(month(l_shipdate) as varchar),
       cast(l_discount as varchar) from lineitem"""

SQL["multi_source_union"] = """
select c_name as name, c_acctbal as balance, 'customer' as source from customer
union all
select s_name, s_acctbal, 'supplier' from supplier"""

SQL["metro_filter"] = """
select c_custkey as customer_id, c_name as customer_name,
       lpad(cast(c_nationkey as varchar), 3, '0') as nation_code, c_mktsegment as segment,
       c_acctbal as balance
from customer
where c_mktsegment = 'BUILDING'
  and lpad(cast(c_nationkey as varchar), 3, '0') in ('001', '003', '005', '007', '011')
  and c_acctbal > 0"""

SQL["paged_json"] = """
select o_orderkey, o_totalprice, cast(o_orderdate as date) as order_date, o_orderpriority from orders"""

SQL["landing_roundtrip"] = """
select o_orderkey, o_totalprice, cast(o_orderdate as date) as order_date, o_orderpriority,
       f.landed_as
from orders, (values ('csv'), ('json')) f(landed_as)"""

from tidewell.plans.civic_queries import CIVIC_SQL  # noqa: E402
from tidewell.plans.landing_queries import LANDING_SQL  # noqa: E402

SQL.update(CIVIC_SQL)
SQL.update(LANDING_SQL)

SQL["stream_refresh"] = SQL["month_refresh"]

SQL["ilike_share"] = """
select cast(year(o_orderdate) as integer) as order_year,
       round(sum(o_totalprice) filter (where o_orderpriority ilike '%hIgH%'), 2) as high_total,
       count(*) filter (where o_orderpriority ilike '_-%urgent') as urgent_count
from orders where o_orderdate is not null group by 1"""

SQL["years_before_last"] = """
select cast(year(o_orderdate) as integer) as order_year, count(*) as order_count from orders
where year(o_orderdate) < (select max(year(o_orderdate)) from orders) group by 1"""

SQL["metric_read"] = """
select cast(max(c_acctbal) as double) as value from customer"""

SQL["title_case"] = """
with t as (select p_partkey, lower('o''' || p_name || '/2nd-' || p_name) as s from part)
select p_partkey, array_to_string(list_transform(range(1, length(s) + 1), lambda i:
         case when i = 1 or not regexp_matches(s[i - 1], '[a-z]') then upper(s[i]) else s[i] end), '') as title
from t"""

SQL["rebuild_shrunk"] = """
select cast(date_trunc('month', o_orderdate) as date) as order_month, count(*) as order_count
from orders where month(o_orderdate) <= 6 group by 1"""
