"""SQL for the registered queries, written apart from them."""

from __future__ import annotations

FILLS = """fills as (select concat('S', cast(l_suppkey % 10 as varchar)) as symbol, cast(l_shipdate as date) as d, l_extendedprice / l_quantity as price, l_quantity as qty, l_returnflag = 'R' as maker, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate from lineitem)"""
BARS = f"""{FILLS}, ranked as (select *, row_number() over (partition by symbol, d order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) as k, row_number() over (partition by symbol, d order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_shipdate desc) as kd from fills),
bars as (select symbol, d, max(case when k = 1 then price end) as open, max(price) as high, min(price) as low, max(case when kd = 1 then price end) as close, sum(qty) as volume, count(*) as trades, sum(case when maker then 0.0 else qty end) as taker_buy from ranked group by symbol, d)"""
TICKS = """ticks as (select event_id, concat('U', cast(user_id % 10 as varchar)) as symbol, ts, value as price, cast(1 + event_id % 5 as double) as qty, event_type in ('error', 'signup') as maker, event_type from events)"""
FILINGS = """filings as (select concat('S', cast(o_custkey % 10 as varchar)) as symbol, cast(o_orderdate as date) as filing_date, case left(o_orderpriority, 1) when '1' then '8-K' when '2' then '10-Q' when '3' then '10-K' else '4' end as form, o_orderkey as accession from orders)"""
PREDS = f"""{BARS}, preds0 as (select symbol, d, close, max(close) over (partition by symbol order by d rows between 1 following and 5 following) / close as peak, ((date_diff('day', date '1995-01-01', d) * 37 + cast(substr(symbol, 2) as int) * 101) % 1000) / 1000.0 as prob, case when (date_diff('day', date '1995-01-01', d) + cast(substr(symbol, 2) as int)) % 2 = 0 then '5d' else '10d' end as horizon, cast(year(d) as int) as model from bars),
preds as (select *, peak >= 2.0 as hit, peak - 1 as ret from preds0)"""
W = "(partition by symbol order by d)"


def w(lo: str, hi: str) -> str:
    return f"(partition by symbol order by d rows between {lo} and {hi})"


LAG = lambda k: f"case when lag(close, {k}) over {W} > 0 then close / lag(close, {k}) over {W} - 1 end"


def _trade_window(hours: int) -> str:
    start = "date_trunc('hour', ts)" if hours == 1 else f"time_bucket(interval {hours} hour, ts, timestamp '1970-01-01')"
    return f"""{TICKS}, tw as (select *, {start} as window_start from ticks), tr as (select *, row_number() over (partition by symbol, window_start order by ts, event_id) as k, row_number() over (partition by symbol, window_start order by ts desc, event_id desc) as kd from tw)"""


def _asof(select: str, cond: str, extra: str = "") -> str:
    return f"""with {BARS}, {FILINGS}, f as (select symbol, filing_date, max(accession) as accession{extra} from filings {select} group by symbol, filing_date),
    m as (select b.symbol, b.d, (select max(filing_date) from f where f.symbol = b.symbol and f.filing_date {cond} b.d) as match_t from bars b)"""


def all_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["a0_bars"] = f"with {BARS} select symbol, d, round(open, 8) as open, round(high, 8) as high, round(low, 8) as low, round(close, 8) as close, volume, trades, taker_buy from bars"
    s["a7_keyed_upsert"] = f"with {BARS}, n as (select symbol, d + 1 as d, trades * 10 as trades, 1.0 as volume from bars where trades > 2) select coalesce(b.symbol, n.symbol) as symbol, cast(coalesce(b.d, n.d) as date) as d, coalesce(n.trades, b.trades) as trades, cast(coalesce(b.volume, n.volume) as double) as volume from bars b full join n on b.symbol = n.symbol and b.d = n.d"
    s["a8_insert_or_ignore"] = f"with {BARS} select symbol, d, trades from bars union all select symbol, cast(d + 1 as date), trades + 100 from bars b where not exists (select 1 from bars c where c.symbol = b.symbol and c.d = b.d + 1)"
    s["a13_retention"] = f"with {BARS} select symbol, d, trades from bars where d >= date '2001-11-04' - 90"
    s["a16_ordered_export"] = f"with {PREDS} select symbol, d, prob, cast(row_number() over (order by prob desc, symbol) as int) as rank, cast(d + 1 as date) as export_date from preds where d = date '1999-06-01' and prob >= 0.1"
    s["b1_safe_ratio"] = f"with {BARS} select symbol, d, round(taker_buy / nullif(volume - taker_buy, 0), 6) as ratio from bars"
    s["b2_bounded_ratio"] = f"with {BARS}, q as (select symbol, d, taker_buy / nullif(volume - taker_buy, 0) as x from bars) select symbol, d, round(case when x between 0.2 and 5 then x end, 6) as ratio, case when x is null then 'missing' when x < 0.2 then 'below_range' when x > 5 then 'above_range' end as reason from q"
    s["b3_step_score"] = f"with {BARS}, q as (select symbol, d, {LAG(20)} as x from bars) select symbol, d, cast(case when x is null then null when x < -0.2 then 10 when x < 0 then 30 when x < 0.2 then 50 when x < 0.5 then 70 else 90 end as double) as score from q"
    s["b4_market_cap_bucket"] = "select s_suppkey, case when s_acctbal is null or s_acctbal <= 0 then 'unknown' when s_acctbal * 1e7 >= 200e9 then 'mega' when s_acctbal * 1e7 >= 10e9 then 'large' when s_acctbal * 1e7 >= 2e9 then 'mid' else 'small' end as bucket from supplier"
    s["b5_prob_bin"] = f"with {PREDS} select round(floor(prob / 0.1) * 0.1, 6) as bin, count(*) as n from preds group by 1"
    s["b7_exclusion_gate"] = f"with {BARS}, q as (select symbol, d, coalesce(close / max(close) over {w('90 preceding', 'current row')} - 1 < -0.2 and {LAG(60)} > 2.0, false) as a, coalesce({LAG(5)} < -0.3, false) as c from bars) select symbol, d, case when a and c then 'A+B' when a then 'A' when c then 'B' end as reason from q"
    s["b8_dual_signal"] = f"with {PREDS} select symbol, d, case when prob >= 0.65 and round(1 - prob, 6) < 0.4 then 'BUY' when round(1 - prob, 6) >= 0.65 and prob < 0.4 then 'SELL' end as signal from preds"
    s["b17_calendar_features"] = f"with {TICKS} select event_id, round(sin(hour(ts) * 2 * pi() / 24), 6) as hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 6) as hour_cos, cast(isodow(ts) - 1 as int) as weekday, hour(ts) between 7 and 15 as london, hour(ts) between 12 and 20 as new_york, hour(ts) < 8 as asian from ticks"
    s["c1_training_set"] = f"with {BARS}, q as (select symbol, d, round({LAG(5)}, 6) as ret_5, max(close) over {w('1 following', '5 following')} / close - 1 >= 0.05 as hit_5 from bars) select * from q where hit_5 is not null and d between date '1996-01-01' and date '1999-12-31'"
    s["c4_row_offset_join"] = f"with {PREDS}, n as (select symbol, d, close, row_number() over {W} as k from bars) select p.symbol, p.d, m.d as mature_d, round(m.close, 8) as mature_close from preds p join n on n.symbol = p.symbol and n.d = p.d left join n m on m.symbol = p.symbol and m.k = n.k + 10 where p.prob >= 0.9"
    s["c5_calendar_offset_join"] = f"with {PREDS} select p.symbol, p.d, round(b.close, 8) as later_close from preds p left join bars b on b.symbol = p.symbol and b.d = p.d + 7 where p.prob >= 0.9"
    s["c6_interval_join_agg"] = f"with {PREDS} select p.symbol, p.d, round(max(b.close), 8) as max_close, round(min(b.close), 8) as min_close, count(*) as n_bars from preds p join bars b on b.symbol = p.symbol and b.d > p.d and b.d <= p.d + 10 where p.prob >= 0.5 group by p.symbol, p.d"
    s["c8_asof_backward"] = _asof("", "<=") + " select m.symbol, m.d, m.match_t, f.accession from m left join f on f.symbol = m.symbol and f.filing_date = m.match_t"
    s["c8_asof_strict"] = _asof("", "<") + " select m.symbol, m.d, m.match_t, f.accession from m left join f on f.symbol = m.symbol and f.filing_date = m.match_t"
    s["c9_latest_of_form"] = _asof("where form in ('10-K', '10-Q')", "<=", ", arg_max(form, accession) as form") + " select m.symbol, m.d, m.match_t, f.form, f.accession from m left join f on f.symbol = m.symbol and f.filing_date = m.match_t"
    s["c11_asof_forward"] = f"with {PREDS}, m as (select p.symbol, p.d, (select min(d) from bars b where b.symbol = p.symbol and b.d >= p.d + 20) as match_t from preds p where prob >= 0.8) select m.symbol, m.d, m.match_t, round(b.close, 8) as close from m left join bars b on b.symbol = m.symbol and b.d = m.match_t"
    s["c12_asof_offset"] = f"with {BARS}, m as (select p.symbol, p.d, p.close, (select max(d) from bars b where b.symbol = p.symbol and b.d <= p.d - 30) as t from bars p) select m.symbol, m.d, round(m.close / b.close - 1, 6) as move from m join bars b on b.symbol = m.symbol and b.d = m.t where round(m.close / b.close - 1, 6) > 0.5"
    s["c13_reconcile"] = f"with {BARS}, x as (select * from bars where trades > 1), y as (select symbol, d, case when trades % 3 = 0 then close * 1.1 else close end as close from bars where d < date '2001-01-01') select case when y.close is null then 'only_left' when x.close is null then 'only_right' when abs(x.close - y.close) > 0.001 then 'breach' else 'matched' end as kind, count(*) as n from x full join y on x.symbol = y.symbol and x.d = y.d group by 1"
    s["c14_semi_filter"] = f"with {BARS} select symbol, d, trades from bars where symbol in (select symbol from bars group by symbol having sum(volume) > 150000 or symbol in ('S1', 'S3'))"
    s["c19_hold_window_sum"] = f"with {TICKS}, rates as (select concat('S', substr(symbol, 2)) as symbol, cast(ts as date) as day, (price - 50) / 100000 as rate from ticks where event_type = 'view'), t as (select distinct symbol, day as d from rates) select t.symbol, t.d, round(sum(r.rate), 9) as funding, count(r.rate) as n_rates, count(r.rate) < 10 as few from t left join rates r on r.symbol = t.symbol and r.day >= t.d and r.day < t.d + 5 group by t.symbol, t.d"
    s["d2_cond_counts"] = f"with {PREDS} select horizon, count(*) as n, count(*) filter (hit) as hits, round(avg(cast(hit as double)), 6) as rate from preds where hit is not null group by horizon"
    s["d3_weighted_mean"] = f"with {TICKS} select cast(ts as date) as d, round(sum(price * qty) / sum(qty), 6) as vwap, count(distinct symbol) as n_symbols from ticks group by 1"
    s["d4_last_by_order"] = f"with {TICKS} select symbol, cast(ts as date) as d, arg_max(price, event_id) as last_price, round(avg(price), 6) as mean_price from ticks group by 1, 2"
    s["d5_distinct_counts"] = f"with {FILINGS} select form, count(distinct symbol) as symbols, count(distinct filing_date) as days, count(*) as n from filings group by form"
    s["d6_having_dups"] = f"with {FILINGS} select symbol, filing_date, form, count(*) as n from filings group by all having count(*) > 1"
    s["d7_trade_stats"] = f"with {PREDS}, q as (select horizon, model, ret - 0.5 as ret from preds where ret is not null) select horizon, model, count(*) as n, round(avg(case when ret > 0 then 1.0 else 0.0 end), 5) as win_rate, round(avg(ret), 5) as mean_ret, round(quantile_cont(ret, 0.5), 5) as median_ret, round(sum(case when ret > 0 then ret end) / sum(case when ret < 0 then -ret end), 5) as profit_factor from q group by 1, 2"
    s["d9_event_day_sharpe"] = f"with {PREDS}, q as (select horizon, d, sum(ret) as pnl from preds where ret is not null group by 1, 2) select horizon, count(*) as n_days, round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252), 5) as sharpe from q group by 1"
    s["d10_max_drawdown"] = f"with {BARS}, q as (select symbol, d, case when {LAG(1)} > 0 then 0.01 else -0.011 end as x from bars), e as (select symbol, d, 1 + sum(x) over {w('unbounded preceding', 'current row')} as equity from q), p as (select *, max(equity) over {w('unbounded preceding', 'current row')} as peak from e) select symbol, round(min((equity - peak) / nullif(peak, 0)), 6) as max_drawdown from p group by symbol"
    s["d11_topn_daily_sharpe"] = f"with {PREDS}, t as (select *, row_number() over (partition by d order by prob desc, symbol) as k from preds where ret is not null), q as (select d, sum(ret * 0.8 / 6) as pnl from t where k <= 6 group by d) select count(*) as n_days, round(avg(pnl) / stddev_samp(pnl) * sqrt(252), 5) as sharpe from q"
    s["d12_reliability"] = f"with {PREDS}, g as (select cast(i as int) as bucket, round(i * 0.2, 1) as lo, round(i * 0.2 + 0.2, 1) as hi from range(6) t(i)), q as (select bucket, lo, hi, count(p.prob) as n, count(p.prob) filter (p.hit) as hits from g left join (select * from preds where hit is not null) p on p.prob >= lo and (p.prob < hi or bucket = 5 and p.prob <= hi) group by 1, 2, 3) select bucket, n, hits, round(hits / nullif(n, 0), 6) as rate, round((hits / nullif(n, 0) - (lo + hi) / 2) * 100, 6) as dev_pp from q"
    s["d16_auc"] = f"with {PREDS}, q as (select model, hit, rank() over (partition by model order by prob) + (count(*) over (partition by model, prob) - 1) / 2.0 as r from preds where hit is not null) select model, round((sum(case when hit then r end) - count(*) filter (hit) * (count(*) filter (hit) + 1) / 2.0) / nullif(count(*) filter (hit) * count(*) filter (not hit), 0), 6) as auc from q group by model"
    s["d17_threshold_sweep"] = f"with {PREDS}, g as (select round(0.3 + 0.02 * i, 2) as threshold from range(25) t(i)), p as (select prob, hit from preds where hit is not null) select threshold, count(*) filter (prob >= threshold) as n, round(count(*) filter (prob >= threshold and hit) / nullif(count(*) filter (prob >= threshold), 0), 6) as precision, round(count(*) filter (prob >= threshold and hit) / count(*) filter (hit), 6) as recall from g, p group by threshold"
    s["d18_precision_at_k"] = f"with {PREDS}, t as (select *, row_number() over (partition by model order by prob desc, symbol) as k from preds where hit is not null) select model, round(avg(cast(hit as double)), 6) as precision from t where k <= 20 group by model"
    s["d19_brier"] = f"with {PREDS} select strftime(d, '%Y-%m') as month, round(avg((prob - cast(hit as double)) * (prob - cast(hit as double))), 6) as brier from preds where hit is not null group by 1"
    s["d20_linear_trend"] = f"with {BARS}, m as (select symbol, year(d) as year, avg(close) as y from bars group by 1, 2) select symbol, round(regr_slope(y, year), 4) as slope, round(regr_intercept(y, year), 2) as intercept, count(*) as n from m group by 1 having count(*) >= 3"
    s["d22_class_weight"] = f"with {PREDS} select horizon, round(count(*) filter (not hit) / nullif(count(*) filter (hit), 0), 6) as weight from preds where hit is not null group by 1"
    s["d23_sector_concentration"] = "with n as (select r_name as sector, count(*) as n from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1) select sector, n, round(n / sum(n) over (), 6) as share, round(n / sum(n) over (), 6) > 0.3 as heavy from n"
    s["d24_regime"] = f"with {PREDS}, q as (select d, avg(case when prob >= 0.6 then 1.0 else 0.0 end) as share from preds group by d) select d, case when share >= 0.5 then 'high' when share >= 0.2 then 'normal' else 'low' end as regime from q"
    s["d32_monthly_distribution"] = f"with {BARS}, m as (select symbol, date_trunc('month', d) as m, arg_max(close, d) as last from bars group by 1, 2), c as (select symbol, last / lag(last) over (partition by symbol order by m) - 1 as ch from m) select symbol, " + ", ".join(f"round(quantile_cont(ch, {p / 100}), 6) as p{p}" for p in (5, 25, 50, 75, 95)) + " from c group by symbol"
    s["e1_lag_returns"] = f"with {BARS} select symbol, d, round({LAG(1)}, 6) as ret_1, round({LAG(5)}, 6) as ret_5, round({LAG(20)}, 6) as ret_20 from bars"
    s["e2_sma_distance"] = f"with {BARS} select symbol, d, round(case when row_number() over {W} >= 20 then close / avg(close) over {w('19 preceding', 'current row')} - 1 end, 6) as sma_dist_20, round(close / avg(close) over {w('49 preceding', 'current row')} - 1, 6) as sma_dist_50 from bars"
    s["e3_bollinger"] = f"with {BARS}, q as (select symbol, d, close, avg(close) over {w('19 preceding', 'current row')} as m, stddev_samp(close) over {w('19 preceding', 'current row')} as sd from bars) select symbol, d, round(case when sd = 0 then 0.0 else (close - m) / (2 * sd) end, 5) as bollinger from q"
    s["e4_rolling_extremes"] = f"with {BARS}, q as (select symbol, d, close, max(close) over {w('252 preceding', 'current row')} as hi, min(close) over {w('252 preceding', 'current row')} as lo from bars) select symbol, d, round(close / hi - 1, 6) as drawdown, round(close / lo - 1, 6) as rally, round((close - lo) / nullif(hi - lo, 0), 6) as place from q"
    s["e5_realized_vol"] = f"with {BARS}, q as (select symbol, d, ln(close / lag(close) over {W}) as lr from bars) select symbol, d, round(case when count(lr) over {w('20 preceding', '1 preceding')} >= 2 then stddev_samp(lr) over {w('20 preceding', '1 preceding')} end * sqrt(252), 6) as vol_prior, round(case when count(lr) over {w('29 preceding', 'current row')} >= 30 then stddev_samp(lr) over {w('29 preceding', 'current row')} end * sqrt(365), 6) as vol from q"
    s["e6_atr"] = f"with {BARS}, q as (select symbol, d, close, greatest(high - low, abs(high - lag(close) over {W}), abs(low - lag(close) over {W})) as tr from bars) select symbol, d, round(tr, 8) as true_range, round(avg(tr) over {w('13 preceding', 'current row')} / close, 8) as atr_pct from q"
    s["e7_relative_volume"] = f"with {BARS}, q as (select symbol, d, volume, avg(volume) over {w('20 preceding', '1 preceding')} as m from bars) select symbol, d, round(case when m > 0 then least(10.0, volume / m) end, 6) as rel_volume from q"
    s["e10_rolling_slope"] = f"with {BARS}, q as (select symbol, d, volume, row_number() over {W} as k from bars) select symbol, d, round(case when k >= 5 then regr_slope(volume, k) over {w('4 preceding', 'current row')} / nullif(avg(volume) over {w('4 preceding', 'current row')}, 0) end, 11) as volume_slope from q"
    s["e11_rolling_beta"] = f"with {BARS}, r as (select symbol, d, {LAG(1)} as r from bars), q as (select a.symbol, a.d, a.r, b.r as b from r a join r b on b.symbol = 'S0' and b.d = a.d where a.r is not null and b.r is not null) select symbol, d, round(case when count(*) over {w('59 preceding', 'current row')} >= 55 then covar_pop(r, b) over {w('59 preceding', 'current row')} / nullif(var_pop(b) over {w('59 preceding', 'current row')}, 0) end, 4) as beta from q"
    s["e12_relative_return"] = f"with {BARS}, r as (select symbol, d, {LAG(5)} as r from bars) select a.symbol, a.d, round(a.r - b.r, 5) as rel_return from r a left join r b on b.symbol = 'S0' and b.d = a.d"
    s["e13_candle_shape"] = f"with {BARS} select symbol, d, round(abs(close - open) / nullif(high - low, 0), 5) as body, round((high - greatest(open, close)) / nullif(high - low, 0), 5) as upper_wick, round((least(open, close) - low) / nullif(high - low, 0), 5) as lower_wick, round(case when high = low then 0.5 else (close - low) / (high - low) end, 5) as close_in_range, round(open / lag(close) over {W} - 1, 5) as gap from bars"
    s["e14_streaks"] = f"with {BARS}, q as (select symbol, d, coalesce(sign(close - lag(close) over {W}), 0) as s, row_number() over {W} as k from bars), g as (select *, k - row_number() over (partition by symbol, s order by d) as g from q), h as (select *, row_number() over (partition by symbol, s, g order by d) as n from g) select symbol, d, cast(case when s > 0 then n else 0 end as int) as up_streak, cast(case when s < 0 then n else 0 end as int) as down_streak from h"
    fwd = lambda f, h: f"{f}(close) over {w('1 following', f'{h} following')} / close - 1"
    s["e16_forward_labels"] = f"with {BARS} select symbol, d, round(lead(close, 5) over {W} / close - 1, 6) as fwd_ret_5, round({fwd('max', 5)}, 6) as fwd_max_5, round({fwd('min', 5)}, 6) as fwd_min_5, round(lead(close, 10) over {W} / close - 1, 6) as fwd_ret_10, round({fwd('max', 10)}, 6) as fwd_max_10, {fwd('max', 5)} >= 0.5 as hit_5, {fwd('max', 10)} >= 0.5 as hit_10 from bars"
    s["e18_knockout"] = f"with {BARS}, n as (select *, row_number() over {W} as k from bars), q as (select a.symbol, a.d, min(case when b.high >= a.close * 1.1 then b.k - a.k end) as up, min(case when b.low <= a.close * 0.95 then b.k - a.k end) as down from n a left join n b on b.symbol = a.symbol and b.k > a.k and b.k <= a.k + 5 group by a.symbol, a.d) select symbol, d, case when down is not null and (up is null or down <= up) then 'stop' when up is not null then 'target' else 'none' end as outcome, cast(case when down is not null and (up is null or down <= up) then down else up end as int) as bar from q"
    s["e20_latest_per_key"] = f"with {FILINGS} select symbol, filing_date, form, accession from filings qualify row_number() over (partition by symbol, form order by filing_date desc, accession desc) = 1"
    s["e22_trail_line"] = f"with {BARS}, q as (select symbol, d, first_value(close) over {W} as e, max(close) over {w('unbounded preceding', 'current row')} as peak from bars) select symbol, d, round(peak, 8) as peak, round(case when peak >= e * 1.1 then peak - (peak - e) * 0.3 else e * 1.1 end, 8) as line from q"
    s["e29_event_counts"] = f"with {BARS}, {FILINGS} select b.symbol, b.d, count(distinct f.accession) as n from bars b left join filings f on f.symbol = b.symbol and f.form = '8-K' and f.filing_date <= b.d and f.filing_date > b.d - 14 group by 1, 2"
    s["e32_dominance"] = f"with {BARS} select symbol, d, round(sum(case when symbol = 'S0' then volume end) over (partition by d) / sum(volume) over (partition by d), 5) as bench_share, round(log10(greatest(1.0, volume * close)), 5) as log_dollar from bars"
    s["e33_volume_rank"] = f"with {BARS}, q as (select symbol, avg(close * volume) as dollar from bars where d <= date '2000-06-30' and d > date '2000-06-30' - 90 group by 1) select symbol, round(dollar, 2) as dollar, cast(rank() over (order by dollar desc) as int) as rank from q"
    s["e36_breakouts"] = f"with {BARS}, q as (select symbol, d, close, max(close) over (partition by symbol order by d range between interval 252 days preceding and interval 1 days preceding) as prior_high from bars) select symbol, d, round(close, 8) as close, round(prior_high, 8) as prior_high from q where close > prior_high qualify row_number() over {W} = 1"
    s["e38_episodes"] = f"with {BARS}, moves as (select * from (select *, {LAG(1)} as m from bars) where abs(m) > 0.1), x as (select *, case when d - lag(d) over {W} <= 5 then 0 else 1 end as new from moves), y as (select *, sum(new) over {w('unbounded preceding', 'current row')} as g from x) select symbol, min(d) as first_day, max(d) as last_day, count(*) as n, round(max(close), 7) as best, round(arg_max(close, d) / arg_min(close, d) - 1, 7) as total_ret, round(max(close) / arg_min(close, d) - 1, 7) as best_ret from y group by symbol, g"
    s["e42_gap_days"] = f"with {BARS}, g as (select symbol, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) as d from bars group by symbol) select symbol, d from g where not exists (select 1 from bars b where b.symbol = g.symbol and b.d = g.d)"
    s["g1_top_n_per_group"] = f"with {PREDS}, t as (select symbol, d, prob, cast(row_number() over (partition by d order by prob desc, symbol) as int) as rank_in_day from preds) select * from t where rank_in_day <= 3"
    s["g3_adaptive_select"] = f"with {PREDS}, c as (select symbol, d, prob, count(*) filter (prob >= 0.6) over (partition by d) >= 3 as confident from preds), t as (select *, cast(row_number() over (partition by d order by prob desc, symbol) as int) as rank_in_day from c where prob >= case when confident then 0.6 else 0.5 end) select * from t where rank_in_day <= 4"
    s["g4_cap_per_key"] = f"with {FILINGS}, t as (select *, row_number() over (partition by symbol order by form, filing_date desc, accession) as k from filings) select symbol, form, filing_date, accession from t where k <= 3 order by form, filing_date desc, accession limit 20"
    s["g5_hash_sample"] = f"with {FILINGS} select accession, sha256(concat(cast(accession as varchar), 'salt')) as h from filings order by h limit 50"
    s["g7_latest_dates"] = f"with {BARS} select d from bars group by d order by d desc limit 7"
    s["h1_candidate_union"] = f"with {BARS} select symbol, d, case when not volume > much then 'add' when not trades > many then 'remove' else 'keep' end as change from bars, (select avg(trades) * 1.3 as many, avg(volume) * 1.3 as much from bars) where trades > many or volume > much"
    s["h2_distinct_rows"] = f"with {FILINGS} select symbol, form from filings group by symbol, form"
    s["h3_html_text"] = r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) as text from pages"""
    s["h9_surprise_pct"] = "select p_partkey, round((p_retailprice - p_size * 40) / nullif(abs(p_size * 40), 0) * 100, 7) as surprise from part"
    s["h13_dates"] = f"with {FILINGS} select accession, cast(date_trunc('month', filing_date) as date) as month, cast(date_diff('day', filing_date, date '2001-12-31') as int) as age, cast(filing_date + 45 as date) as due, cast(quarter(filing_date) as int) as quarter from filings"
    s["h14_filtered_search"] = "select 'text' as search, s_suppkey, s_name from supplier where s_acctbal between 0 and 10000 and (s_name ilike '%R#00000001%' or concat('T', s_suppkey * 7) ilike '%R#00000001%') union all select 'tier', s_suppkey, s_name from supplier where s_nationkey < 8 and s_acctbal between 1000 and 10000 union all select 'all', s_suppkey, s_name from supplier where s_nationkey >= 8 and s_acctbal between -500 and 5000 and (s_name ilike '%11%' or concat('T', s_suppkey * 7) ilike '%11%')"
    s["i1_trades_window"] = f"with {_trade_window(1)} select symbol, window_start, sum(case when maker then 0.0 else qty end) as buy_volume, sum(case when maker then qty else 0.0 end) as sell_volume, round(sum(price * qty), 6) as notional, count(*) as n, max(case when k = 1 then price end) as open, max(price) as high, min(price) as low, max(case when kd = 1 then price end) as close, max(qty) as qty_max, round(avg(qty), 6) as qty_mean from tr group by 1, 2"
    s["i6_asof_window"] = f"with {_trade_window(6)} select symbol, window_start, price, qty, event_id from tr where kd = 1"
    s["i7_settled"] = f"with {_trade_window(1)} select symbol, window_start, count(*) as n from tr where window_start + interval 3690 second <= timestamp '2024-01-15 12:00:30' group by 1, 2"
    s["i12_sequence_gaps"] = f"with {TICKS}, x as (select symbol, event_id as u, lag(event_id) over (partition by symbol order by event_id) as p from ticks), y as (select symbol, u, case when u % 97 = 0 then -1 else p end as pu from x), z as (select *, lag(u) over (partition by symbol order by u) as expected from y where pu is not null) select symbol, u, pu, expected from z where expected is not null and pu <> expected"
    s["i18_sessions"] = f"with {TICKS}, x as (select *, case when ts - lag(ts) over (partition by symbol order by ts, event_id) < interval 30 minute then 0 else 1 end as new from ticks), y as (select *, sum(new) over (partition by symbol order by ts, event_id) as g from x) select symbol, min(ts) as session_start, count(*) as n, sum(qty) as qty from y group by symbol, g"
    s["j2_trailing_z"] = f"with {BARS}, q as (select symbol, d, volume as v, count(*) over {w('240 preceding', '1 preceding')} as n, avg(volume) over {w('240 preceding', '1 preceding')} as m, stddev_pop(volume) over {w('240 preceding', '1 preceding')} as sd from bars) select symbol, d, round(case when n >= 60 and sd > 0 then (v - m) / sd end, 5) as z from q"
    s["j3_cross_rank"] = f"with {BARS} select symbol, d, round(case when count(*) over (partition by d) >= 5 then (rank() over (partition by d order by volume) - 1 + 0.5 * count(*) over (partition by d, volume)) / count(*) over (partition by d) end, 6) as cross_rank from bars"
    dated = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    undated = "customer supplier part nation region documents embeddings pages benchmark labels conversations".split()
    s["l10_table_inventory"] = " union all ".join([f"select '{t}' as name, count(*) as n, cast(min({c}) as date) as first_day, cast(max({c}) as date) as last_day from {t}" for t, c in dated.items()] + [f"select '{t}', count(*), null, null from {t}" for t in undated])
    return s
