"""SQL for the further bar features, hourly features and window summaries."""

from __future__ import annotations

from .oracle import BARS, PREDS, TICKS, W, w

HOURS = f"""{TICKS}, hrank as (select *, date_trunc('hour', ts) as h, row_number() over (partition by symbol, date_trunc('hour', ts) order by ts, event_id) as k, row_number() over (partition by symbol, date_trunc('hour', ts) order by ts desc, event_id desc) as kd from ticks),
hours as (select symbol, h, max(case when k = 1 then price end) as open, max(price) as high, min(price) as low, max(case when kd = 1 then price end) as close, sum(qty) as volume, count(*) as trades, sum(case when maker then 0.0 else qty end) as taker_buy from hrank group by 1, 2)"""
QUOTES = f"{TICKS}, quotes as (select symbol, ts, event_id, price - 0.05::double as bid, price + 0.05::double * (1 + event_id % 3) as ask, qty as bid_qty, cast(1 + event_id % 7 as double) as ask_qty from ticks)"
H = "(partition by symbol order by h)"
RN = f"row_number() over {H}"
BUCKET6 = "time_bucket(interval 6 hour, ts, timestamp '1970-01-01')"


def hw(lo: str, hi: str) -> str:
    return f"(partition by symbol order by h rows between {lo} and {hi})"


def _rsi(x: str, gain: str, loss: str, result: str) -> str:
    """Exponential sums as one running sum of scaled terms."""
    s = lambda c: f"power(13 / 14.0::double, k) * sum({c} / 14 * power(14 / 13.0::double, k)) over {w('unbounded preceding', 'current row')}"
    return f"with {BARS}, {x}, y as (select symbol, d, k, {s(gain)} as g, {s(loss)} as l from q) select symbol, d, round({result}, 5) as rsi from y"


def all_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["e9_rsi_ewm"] = _rsi(f"q as (select symbol, d, {'row_number() over ' + W} as k, coalesce(greatest(close - lag(close) over {W}, 0), 0) as gn, coalesce(greatest(lag(close) over {W} - close, 0), 0) as ls from bars)", "gn", "ls", "case when k >= 14 and l > 0 then 100 - 100 / (1 + g / l) end")
    x = f"""r as (select symbol, d, ln(close / lag(close) over {W}) as lr, row_number() over {W} - 1 as k from bars), p as (select symbol, d, k, greatest(lr, 0) as gn, greatest(-lr, 0) as ls, avg(greatest(lr, 0)) over {w('13 preceding', 'current row')} as mg, avg(greatest(-lr, 0)) over {w('13 preceding', 'current row')} as ml from r),
    q as (select symbol, d, k, case when k > 14 then gn when k = 14 then mg * 14 else 0 end as gn, case when k > 14 then ls when k = 14 then ml * 14 else 0 end as ls from p)"""
    s["e8_rsi_seeded"] = _rsi(x, "gn", "ls", "case when k >= 14 then case when l > 0 then 100 - 100 / (1 + g / l) else 100.0 end end")
    day = "(partition by symbol, cast(h as date))"
    s["e15_day_place"] = f"with {HOURS} select symbol, h, round((close - min(low) over {day}) / nullif(max(high) over {day} - min(low) over {day}, 0), 6) as day_place, round(max(high) over {hw('8 preceding', '1 preceding')} - min(low) over {hw('8 preceding', '1 preceding')}, 6) as prior_range from hours"
    f = lambda h: f"case when count(*) over {w('1 following', f'{h} following')} = {h} then"
    fx = lambda h: f"round({f(h)} max(high) over {w('1 following', f'{h} following')} - close end, 7) as up_{h}, round({f(h)} close - min(low) over {w('1 following', f'{h} following')} end, 7) as down_{h}, round({f(h)} lead(close, {h}) over {W} - close end, 7) as net_{h}"
    s["e17_forward_pips"] = f"with {BARS}, q as (select symbol, d, {fx(24)}, {fx(48)} from bars) select * from q where up_24 is not null"
    s["e28_macro_trend"] = "with m as (select case left(o_orderpriority, 1) when '1' then '8-K' else '10-Q' end as form, date_trunc('month', o_orderdate) as mo, count(*) as v from orders where left(o_orderpriority, 1) in ('1', '2') group by 1, 2), k as (select *, row_number() over (partition by form order by mo desc) as k from m), p as (select form, max(case when k = 1 then v end) as last, max(case when k = 2 then v end) as prior from k group by 1) select *, case when last > prior then 'rising' when last < prior then 'falling' when prior is not null then 'flat' end as trend from p"
    s["e30_funding_stats"] = f"with {TICKS}, q as (select symbol, cast(ts as date) as d, avg(price) as rate from ticks where event_type = 'view' group by 1, 2) select symbol, d, round(avg(rate) over {w('2 preceding', 'current row')}, 6) as avg_3, round(avg(rate) over {w('6 preceding', 'current row')}, 6) as avg_7, round((rate - avg(rate) over {w('29 preceding', 'current row')}) / nullif(stddev_samp(rate) over {w('29 preceding', 'current row')}, 0), 6) as z from q"
    s["e31_oi_changes"] = f"with {BARS} select symbol, d, " + ", ".join(f"round(volume / lag(volume, {k}) over {W} - 1, 6) as change_{k}" for k in (1, 3, 7)) + f", round(volume / lag(volume) over {W} - 1 - (close / lag(close) over {W} - 1), 6) as divergence from bars"
    s["e35_plausibility"] = f"with {BARS}, b as (select symbol, d, volume, trades, high - low as reach from bars), q as (select *, {', '.join(f"case when count(*) over {w('20 preceding', '1 preceding')} = 20 then quantile_cont({c}, 0.5) over {w('20 preceding', '1 preceding')} end as m_{c}" for c in ('volume', 'trades', 'reach'))} from b), p as (select symbol, d, m_volume, volume / m_volume < 0.2 as low, reach / nullif(m_reach, 0) < 0.2 as low_reach, trades / m_trades < 0.2 as low_trades from q) select symbol, d, round(m_volume, 6) as median_before, low, low_reach, low_trades, count(low) over (partition by d) >= 5 and count(*) filter (low) over (partition by d) > 0.3 * count(low) over (partition by d) as systemic from p"
    s["e39_accumulation_start"] = f"with {BARS}, q as (select symbol, d, lead(close, 4) over {W} / close - 1 as g from bars) select symbol, cast(year(d) as int) as year, min(d) as first_day, round(arg_min(g, d), 6) as gain from q where g >= 0.05 group by 1, 2"
    s["e40_window_return"] = f"with {BARS}, q as (select symbol, d, 1 + (close / lag(close) over {W} - 1) / 100 as f from bars) select symbol, cast(date_trunc('month', d) as date) as month, round(product(f) - 1, 6) as ret from q where f > 0 group by 1, 2"
    s["e43_outcome_complete"] = f"with {BARS}, q as (select a.symbol, a.d, case when count(b.d) >= 8 then max(b.close) end / any_value(a.close) - 1 as best, case when count(b.d) >= 8 then min(b.close) end / any_value(a.close) - 1 as worst from bars a left join bars b on b.symbol = a.symbol and b.d > a.d and b.d <= a.d + 10 group by 1, 2) select symbol, d, round(best, 6) as best, round(worst, 6) as worst from q"
    s["e44_walk_forward_folds"] = f"with {BARS}, m as (select cast(date_trunc('month', d) as date) as t, count(*) as n from bars group by 1) select a.t as test_start, (select coalesce(sum(n), 0) from m b where b.t < a.t) as n_train, a.n as n_test from m a where a.t >= (select min(t) from m) + interval 6 month"
    roc = lambda n: f"close / lag(close, {n}) over {H} - 1"
    s["f1_roc"] = f"with {HOURS} select symbol, h, round({roc(3)}, 6) as roc_3, round({roc(3)} - (lag(close, 3) over {H} / lag(close, 6) over {H} - 1), 6) as accel_3 from hours"
    s["f2_move_shape"] = f"with {HOURS}, q as (select *, abs(close - lag(close) over {H}) as st from hours) select symbol, h, round(max(st) over {hw('11 preceding', 'current row')} / nullif(abs(close - lag(close, 12) over {H}), 0), 5) as shape from q"
    s["f3_vwap_dist"] = f"with {HOURS}, q as (select *, (high + low + close) / 3 * volume as pv from hours), v as (select symbol, h, close, case when {RN} >= 60 then sum(pv) over {hw('59 preceding', 'current row')} / sum(volume) over {hw('59 preceding', 'current row')} end as a, sum(pv) over (partition by symbol, cast(h as date) order by h) / sum(volume) over (partition by symbol, cast(h as date) order by h) as b from q) select symbol, h, round((close - a) / a, 6) as rolling, round((close - b) / b, 6) as session from v"
    s["f4_sma_breakout"] = f"with {HOURS} select symbol, h, round(case when {RN} >= 20 then (close - avg(close) over {hw('19 preceding', 'current row')}) / avg(close) over {hw('19 preceding', 'current row')} end, 6) as sma_20, round(case when {RN} >= 21 then (close - max(high) over {hw('20 preceding', '1 preceding')}) / max(high) over {hw('20 preceding', '1 preceding')} end, 6) as breakout_20 from hours"
    s["f5_up_down_volume"] = f"with {HOURS} select symbol, h, round(case when {RN} >= 12 then sum(case when close > open then volume else 0 end) over {hw('11 preceding', 'current row')} / nullif(sum(case when close < open then volume else 0 end) over {hw('11 preceding', 'current row')}, 0) end, 6) as ratio from hours"
    s["f6_rvol"] = f"with {HOURS} select symbol, h, round(case when {RN} >= 25 then volume / avg(volume) over {hw('24 preceding', '1 preceding')} end, 6) as rvol_1, round(case when {RN} >= 29 then sum(volume) over {hw('4 preceding', 'current row')} / (5 * avg(volume) over {hw('28 preceding', '5 preceding')}) end, 6) as rvol_5 from hours"
    s["f7_taker_imbalance"] = f"with {HOURS} select symbol, h, " + ", ".join(f"round(case when {RN} >= {n} then sum(taker_buy) over {hw(f'{n - 1} preceding', 'current row')} / sum(volume) over {hw(f'{n - 1} preceding', 'current row')} end, 6) as taker_{n}" for n in (1, 5, 15)) + " from hours"
    s["f8_trade_count_ratio"] = f"with {HOURS} select symbol, h, round(case when {RN} >= 25 then trades / avg(trades) over {hw('24 preceding', '1 preceding')} end, 6) as count_ratio, round(case when {RN} >= 25 then volume / trades / avg(volume / trades) over {hw('24 preceding', '1 preceding')} end, 6) as size_ratio from hours"
    s["f9_oi_change"] = f"with {HOURS} select symbol, h, " + ", ".join(f"round(volume / lag(volume, {k}) over {H} - 1, 6) as change_{k}" for k in (1, 3, 12)) + " from hours"
    s["f11_cross_section"] = f"with {HOURS}, q as (select symbol, h, {roc(1)} as x from hours), p as (select * from q where x is not null) select a.symbol, a.h, round(a.x - max(b.x) filter (b.symbol = 'U0'), 6) as vs_bench, round(a.x - quantile_cont(b.x, 0.5), 6) as vs_median, round(count(*) filter (b.x < a.x) / nullif(count(*) - 1, 0), 6) as below from p a join p b on b.h = a.h group by a.symbol, a.h, a.x"
    s["g2_threshold_select"] = f"with {PREDS} select symbol, d, prob, cast(row_number() over (partition by d order by prob desc, symbol) as int) as rank_in_day from preds where prob >= 0.7"
    s["g6_multi_key_nulls_last"] = f"with {PREDS} select symbol, d, cast(row_number() over (partition by model order by hit asc nulls first, ret desc nulls last, d, symbol) as int) as place from preds qualify place <= 20"
    s["h4_contains_quote"] = r"""with b as (select item_id, string_split(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), ' ') as w from benchmark),
        i as (select item_id, w, unnest(range(0, len(w), 3)) as i from b),
        q as (select item_id * 1000 + i as quote_id, array_to_string(w[i + 1:i + i % 11 + 1], ' ') as quote from i),
        t as (select doc_id, lower(trim(regexp_replace(translate(text, '‘’“”', '''''""'), '[ \t\r\n]+', ' ', 'g'))) as t from documents),
        f as (select quote_id, count(*) as n, min(doc_id) as first_doc from q join t on contains(t.t, lower(q.quote)) where length(quote) >= 10 group by quote_id)
        select q.quote_id, q.quote, length(quote) < 10 or f.n is not null as valid, coalesce(f.n, 0) as n_docs, f.first_doc from q left join f on f.quote_id = q.quote_id"""
    s["h7_event_priority"] = "select doc_id, cast(case when source = 'web' then 2 else 1 end + least(len(regexp_extract_all(text, '(report|market|price)')), 3) + case when length(text) > 2000 then 1 else 0 end as int) as priority from documents"
    s["h8_source_coverage"] = "select source, count(*) as n, count(*) filter (length(text) > 1000) as long, count(*) filter (length(text) < 100) as short, count(*) filter (lang is null) as unknown from documents group by 1"
    s["h10_row_fingerprint"] = """select c_custkey, sha256(concat('{"name":"', c_name, '","customer":', c_custkey, ',"nation":', c_nationkey, '}')) as fingerprint from customer"""
    s["h11_json_metadata"] = """select o_custkey, concat('{"n":', count(*), ',"first":', min(o_orderkey), '}') as meta, cast(min(o_orderkey) as bigint) as first_key from orders group by 1"""
    s["i2_bookticker_window"] = f"with {QUOTES} select symbol, date_trunc('hour', ts) as window_start, round(arg_min(bid, event_id), 6) as bid_open, round(max(bid), 6) as bid_high, round(min(bid), 6) as bid_low, round(arg_max(bid, event_id), 6) as bid_close, round(arg_min(ask, event_id), 6) as ask_open, round(arg_max(ask, event_id), 6) as ask_close, round(avg(bid_qty), 6) as bid_qty_mean, round(max(ask - bid), 6) as spread_max, round(avg(ask - bid), 6) as spread_mean, arg_max(bid_qty, event_id) as bid_qty_last, max(ask_qty) as ask_qty_max, min(ask_qty) as ask_qty_min, count(*) as n from quotes group by 1, 2"
    s["i4_liquidation_window"] = f"with {TICKS} select symbol, {BUCKET6} as window_start, coalesce(sum(qty) filter (not maker), 0) as buy_volume, coalesce(sum(qty) filter (maker), 0) as sell_volume, round(coalesce(sum(price * qty) filter (not maker), 0), 6) as buy_notional, round(coalesce(sum(price * qty) filter (maker), 0), 6) as sell_notional, count(*) filter (not maker) as buys, count(*) filter (maker) as sells from ticks group by 1, 2"
    s["i5_depth_window"] = f"""with {QUOTES}, l as (select symbol, ts, event_id, unnest(['bid', 'ask']) as side, bid, ask, bid_qty, ask_qty from quotes), p as (select symbol, ts, event_id, side, cast(i + 1 as int) as level, case side when 'bid' then bid - 0.05::double * i else ask + 0.05::double * i end as price, case side when 'bid' then bid_qty else ask_qty end + i as qty from l, range(22) r(i) where i < event_id % 20 + 3),
        t as (select symbol, ts, side, event_id, sum(qty) as q, sum(price * qty) as v from p group by all)
        select symbol, {BUCKET6} as window_start, side, level, null as samples, round(arg_min(price, (ts, event_id)), 6) as price_open, round(max(price), 6) as price_high, round(min(price), 6) as price_low, round(arg_max(price, (ts, event_id)), 6) as price_close, round(avg(qty), 6) as qty_mean, arg_max(qty, (ts, event_id)) as qty_last, min(qty) as qty_min, max(qty) as qty_max, null as notional_mean, null as notional_max, null as notional_min from p where level between 2 and 20 group by all
        union all select symbol, {BUCKET6}, side, 0, count(*), null, null, null, null, null, null, min(q), max(q), round(avg(v) + 1e-7, 4), round(max(v) + 1e-7, 4), round(min(v) + 1e-7, 4) from t group by 1, 2, 3"""
    s["i9_window_dedup"] = f"with {HOURS} select symbol, h, case when trades < 4 then trades else trades * 10 end as trades from hours"
    s["i11_path_labels"] = f"""with {HOURS}, gaps as (select h as a, h + interval 30 minute as b from hours where symbol = 'U3' and hour(h) = 5), x as (select symbol, h, close, unnest([1, 4, 12]) as horizon from hours), y as (select * from x where h + to_hours(horizon) <= (select max(h) from hours)),
    z as (select y.symbol, y.h, y.horizon, y.close, max(b.high) / y.close - 1 as mfe, min(b.low) / y.close - 1 as mae, max(case when b.h = y.h + to_hours(y.horizon) then b.close end) / y.close - 1 as fr, count(b.h) = y.horizon as complete from y left join hours b on b.symbol = y.symbol and b.h > y.h and b.h <= y.h + to_hours(y.horizon) group by 1, 2, 3, 4)
    select symbol, h, cast(horizon as int) as horizon, round(fr, 6) as fwd_return, round(mfe, 6) as mfe, round(mae, 6) as mae, complete and not exists (select 1 from gaps where a <= z.h + interval 1 hour + to_hours(z.horizon) and b >= z.h + interval 1 hour) as valid from z"""
    s["i13_book_reconstruct"] = f"with {TICKS}, c as (select symbol, event_id as u, case when maker then 'bid' else 'ask' end as side, floor(price) as price, cast(event_id % 4 as double) as qty, event_id % 1009 = 0 as snap from ticks), st as (select symbol, max(u) as f from c where snap group by 1), l as (select c.* from c left join st on st.symbol = c.symbol where st.f is null or c.u >= st.f), b as (select symbol, side, price, arg_max(qty, u) as qty from l group by 1, 2, 3) select symbol, side, price, qty, cast(row_number() over (partition by symbol, side order by case when side = 'bid' then -price else price end) as int) as level from b where qty > 0 qualify level <= 5"
    s["i14_quality_asserts"] = f"with {PREDS} select 'filled_without_hit' as \"check\", count(*) filter (ret is not null and hit is null) as n from preds union all select 'pending_with_hit', count(*) filter (ret is null and hit is not null) from preds union all select 'prob_range', count(*) filter (prob < 0 or prob > 1) from preds union all select 'horizon_name', count(*) filter (horizon not in ('5d', '10d')) from preds union all select 'pending', count(*) filter (ret is null) from preds"
    s["i17_stall_peers"] = f"""with {TICKS}, n as (select max(ts) as now from ticks),
        l as (select symbol, max(ts) as ts, count(*) as rows, count(*) filter (ts <= now - interval 6 hour) as early from ticks, n group by symbol),
        m as (select l.*, now - ts > interval 3 hour as old, early > 0 and rows > early as moved from l, n),
        e as (select concat('U', i) as symbol from range(12) r(i))
        select coalesce(e.symbol, m.symbol) as symbol, case when m.symbol is null then 'missing' when old then 'stale'
            when early > 0 and not moved and (select bool_or(moved and not old) from m) then 'stalled' else 'fresh' end as state
        from e full join m on m.symbol = e.symbol"""
    s["j6_lifts"] = f"with {BARS}, q as (select symbol, d, max(close) over {w('1 following', '5 following')} / close + min(close) over {w('1 following', '5 following')} / close - 2 as v from bars) select symbol, d, round(v - avg(v) over (partition by symbol), 5) as lift from q where v is not null"
    s["j13_coin_vol"] = f"with {HOURS}, q as (select symbol, {roc(1)} as x from hours) select symbol, round(stddev_pop(x), 5) as vol, count(x) as n from q group by 1"
    s["l3_stale_guard"] = f"with {PREDS} select (select max(d) from bars) as price_day, max(d) as feature_day, max(d) < (select max(d) from bars) as stale from preds where ret is not null"
    s["l6_model_drift"] = f"with {PREDS}, b as (select horizon, avg(cast(hit as double)) as rate from preds where hit is not null group by 1), q as (select horizon, d, hit from preds where hit is not null and prob >= 0.6), y as (select distinct horizon, d from q), z as (select y.horizon, y.d, count(*) as n7, count(*) filter (q.hit) / count(*) as p7 from y join q on q.horizon = y.horizon and q.d <= y.d and q.d >= y.d - 6 group by 1, 2) select z.horizon, z.d, n7, round(p7, 6) as p7, n7 >= 5 and rate < 0.95 and round(p7 / rate, 9) < 0.8 as drift from z join b on b.horizon = z.horizon"
    return s
