"""SQL for parsed rows, universe upkeep, rules over windows and review sections."""

from __future__ import annotations

from .oracle import BARS, LAG, PREDS, TICKS, W, w
from .oracle_intraday import BUCKET6, QUOTES
from .oracle_paths import CANDS

FIRED = f"""{BARS}, ft as (select symbol, d, close, {LAG(1)} as r1, {LAG(5)} as r5, case when row_number() over {W} >= 20 then close / avg(close) over {w('19 preceding', 'current row')} - 1 end as sd from bars),
fired as (select 1 as rule, symbol, d from ft where r1 > 0.5 and sd < 0 union all select 2, symbol, d from ft where r5 < -0.3 union all select 3, symbol, d from ft where r1 < -0.2 and r5 > 0.2 and sd > -0.5)"""


SERIES = ", ".join(f"round({f}, 6) as {c}_{n}" for c, e, w in (("index", "price * 1.001::double", "event_id % 3 <> 0"), ("settle", "price * 0.999::double", "event_id % 5 = 0")) for n, f in (("open", f"arg_min({e}, event_id) filter ({w})"), ("high", f"max({e}) filter ({w})"), ("low", f"min({e}) filter ({w})"), ("close", f"arg_max({e}, event_id) filter ({w})")))


def all_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["a2_typed_rows"] = f"with {TICKS} select event_id, case when event_id % 5 <> 0 and event_id % 7 <> 0 then event_id end as u, qty from ticks"
    s["a3_csv_bars"] = "select cast(o_orderkey as varchar) as symbol, cast(o_orderdate as date) as d, " + ", ".join(f"cast(o_orderkey % 1000 as double) as {c}" for c in ("open", "high", "low", "close", "adjusted_close")) + ", 10.0::double as volume from orders where o_orderkey % 9 <> 0 and o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0"
    s["a4_json_klines"] = "select concat('K', event_id % 3) as symbol, event_id * 60000 as open_ms, 1.0::double as open, cast(event_id % 9 as double) as high, 0.5::double as low, 1.5::double as close, 7.0::double as volume, event_id * 60000 + 59999 as close_ms from events where event_id * 60000 + 59999 <= 300000000"
    s["b21_refresh_queue"] = "with l as (select o_custkey, max(cast(o_orderdate as date)) as m from orders group by 1), q as (select c_custkey, m, date_diff('day', m, date '2001-12-31') as age, c_acctbal from customer left join l on o_custkey = c_custkey), p as (select c_custkey, concat_ws('|', case when m is null then 'no_prices' end, case when age > 10 then concat('stale_prices_', age, 'd') end, case when c_acctbal < 0 then 'no_fundamentals' end, case when c_custkey % 3 = 0 then 'no_market_cap' end) as reason, case when m is null then 1 when age > 10 then 2 when c_acctbal < 0 then 3 when c_custkey % 3 = 0 then 4 end as priority from q) select * from p where priority is not null order by priority, c_custkey limit 100"
    s["c23_membership_at_time"] = f"with {PREDS}, q as (select a.symbol, a.d, sum(b.volume) as past from bars a left join bars b on b.symbol = a.symbol and b.d >= a.d - 30 and b.d < a.d group by 1, 2), k as (select symbol, d, rank() over (partition by d order by past desc nulls last) as k from q) select p.model, count(*) as n, round(avg(case when k.k > 5 then 1.0 else 0.0 end), 6) as outside from preds p join k on k.symbol = p.symbol and k.d = p.d where p.prob >= 0.5 group by 1"
    s["d30_order_vwap"] = "with q as (select l_orderkey, cast(sum(l_quantity) as double) as qty, round(cast(sum(l_extendedprice) as double) / cast(sum(l_quantity) as double), 9) as vwap from lineitem group by 1) select l_orderkey, qty, vwap, vwap * (1 - 0.0009::double) > 2000 as won from q"
    s["d31_settled_label_hit"] = f"with {PREDS} select horizon, model, count(*) as n, count(*) filter (hit) as hits, round(avg(cast(hit as double)), 6) as rate from preds where hit is not null and d + case when horizon = '5d' then 7 else 14 end <= date '2000-06-30' group by 1, 2"
    s["d42_daily_balance"] = f"with {PREDS}, q as (select horizon, d, sum(ln(1 + ret)) as pnl, count(*) as n from preds where ret is not null group by 1, 2) select horizon, d, n, round(pnl - lag(pnl) over (partition by horizon order by d), 6) as delta, round(sum(pnl) over (partition by horizon order by d), 5) as running from q"
    s["d42_preliminary"] = f"""with {PREDS}, p as (
            select symbol, d as entry_day, date_diff('day', date '1995-01-01', d) as n, close as entry, prob from preds
            where prob >= 0.9 and d between date '1997-01-01' and date '1999-06-30'),
        pos as (select symbol, entry_day, case when n % 10 <> 0 then entry_day + cast(5 + n % 7 as int) end as exit_day, entry, 1 + n % 3 as qty, (prob - 0.94::double) * entry as realized from p),
        days as (select d, cast(sum(volume) as double) as equity, false as preliminary from bars where d >= date '1997-01-01' and d < date '1999-06-30' and isodow(d) <> 3 group by d),
        rel as (select exit_day as d, sum(realized) as realized from pos where exit_day is not null group by 1),
        every as (select * from days union all
            select date '1999-06-30', (select arg_max(equity, d) from days) + coalesce((select realized from rel where d = date '1999-06-30'), 0), true),
        held as (select e.d, pos.symbol, sum(pos.qty) as qty, sum(pos.qty * pos.entry) as cost from every e join pos on pos.entry_day <= e.d and (pos.exit_day is null or pos.exit_day > e.d) group by 1, 2),
        old as (select symbol, d, close from bars where d < date '1999-06-30'),
        gain as (select h.d, sum(h.qty * o.close - h.cost) as unrealized from held h asof join old o on o.symbol = h.symbol and o.d <= h.d group by 1)
        select e.d, preliminary, round(equity, 7) as equity, round(coalesce(realized, 0), 7) as realized, round(coalesce(unrealized, 0), 7) as unrealized,
            round(equity - lag(equity) over (order by e.d), 7) as delta, round(sum(coalesce(realized, 0)) over (order by e.d), 7) as cumulative
        from every e left join rel using (d) left join gain using (d)"""
    s["e34_universe_hysteresis"] = f"""with {BARS}, a as (select symbol, d, avg(volume) over {w('29 preceding', 'current row')} as m from bars), l as (select d, row_number() over (order by d desc) as back from (select distinct d from bars) qualify back <= 7),
        k as (select symbol, back, row_number() over (partition by d order by m desc, symbol) as rank from a join l using (d)), q as (select symbol, count(*) as n, count(*) filter (rank <= 5) as inside, cast(coalesce(min(back) filter (rank > 5), 8) - 1 as int) as streak, cast(min(rank) filter (back = 1) as int) as rank, cast(substr(symbol, 2) as int) as i from k group by symbol),
        z as (select symbol, n, inside, streak, rank, i % 2 = 0 as active, i, case when n < 7 then 'insufficient_history' when i % 2 = 1 and inside = 7 then case when i = 9 then 'no_listing' when i % 3 = 0 then 'pending' else 'add' end when i % 2 = 0 and inside = 0 then 'remove' else 'keep' end as change from q)
        select * exclude (i), case when change = 'pending' then date '1998-12-31' + 30 end as eligible from z"""
    s["e37_event_clusters"] = f"with {BARS}, r as (select symbol, d, {LAG(1)} as r from bars), x as (select *, case when r > 0 then 'up' else 'down' end as kind from r where r > 1 or r < -0.6), y as (select *, case when d - lag(d) over (partition by symbol, kind order by d) <= 5 then 0 else 1 end as new from x), z as (select *, sum(new) over (partition by symbol, kind order by d) as g from y) select symbol, kind, min(d) as first_day, max(d) as last_day, count(*) as n, round(max(abs(r)), 6) as best from z group by symbol, kind, g"
    s["e41_downsample"] = f"with {BARS}, q as (select symbol, d, round(close, 8) as close, row_number() over {W} as k, count(*) over (partition by symbol) as n from bars), p as (select *, row_number() over (partition by symbol order by close desc, k desc) as a, row_number() over (partition by symbol order by close, k) as b from q) select symbol, d, close from p where (k - 1) % cast(ceil(n / 100.0) as bigint) = 0 or k = n or a = 1 or b = 1"
    s["f10_book_imbalance"] = f"with {QUOTES}, l as (select event_id, bid, ask, (bid + ask) / 2 as mid, bid - 0.05::double * i as bp, ask + 0.05::double * i as ap, bid_qty + i as bq, ask_qty + i as aq from quotes, range(10) r(i)), g as (select event_id, any_value(bid) as bid, any_value(ask) as ask, any_value(mid) as mid, coalesce(sum(bq) filter (abs(bp - mid) <= mid * 0.005::double + 1e-9), 0) as b, coalesce(sum(aq) filter (abs(ap - mid) <= mid * 0.005::double + 1e-9), 0) as a from l group by 1) select event_id, round((b - a) / nullif(b + a, 0), 6) as imbalance, round((ask - bid) / mid * 10000, 5) as spread_bps from g"
    s["i3_markprice_window"] = f"with {TICKS} select symbol, {BUCKET6} as window_start, round(arg_min(price, event_id), 6) as mark_open, round(max(price), 6) as mark_high, round(min(price), 6) as mark_low, round(arg_max(price, event_id), 6) as mark_close, round(min(qty / 1000), 6) as funding_low, round(max(qty / 1000), 6) as funding_high, round(arg_max(qty / 1000, event_id), 6) as funding_close, {SERIES}, max(event_id) as next_id from ticks group by 1, 2"
    s["j5_rule_firing"] = f"with {FIRED} select * from fired"
    s["j7_rule_score"] = f"with {FIRED}, x as (select symbol, d, ln(max(close) over {w('1 following', '5 following')} / close) as v from bars), l as (select symbol, d, v - avg(v) over (partition by symbol) as lift from x where v is not null) select rule, count(*) as n, round(avg(lift), 6) as mean_lift from fired f join l on l.symbol = f.symbol and l.d = f.d group by 1 having count(*) >= 20"
    s["j12_forward_confirm"] = f"""with {FIRED}, x as (select symbol, d, ln(lead(close, 5) over {W} / close) as v from bars), q as (select rule, count(*) as n, avg(v) as mean, avg(v) / (stddev_samp(v) / sqrt(count(*))) as t from fired f join x on x.symbol = f.symbol and x.d = f.d where f.d > date '2000-01-01' and v is not null group by 1)
        select rule, n, round(mean, 5) as mean, round(t, 5) as t, case when rule in (1, 3) then case when n >= 30 and not (mean > 0 and mean > case rule when 1 then 0.05 else 0 end) then 'decayed' else 'kept' end when n < 30 then 'wait' when mean > 0.01 and t >= 2 then 'promote' else 'reject' end as verdict from q"""
    s["l4_validate_backfill"] = f"with {PREDS}, q as (select 'prob_range' as name, count(*) filter (prob < 0 or prob > 1) as n from preds union all select 'unfilled', count(*) filter (hit is null and ret is not null) from preds union all select 'price', count(*) filter (close <= 0) from preds union all select 'model_year', count(*) filter (year(d) <> model) from preds union all select 'duplicates', count(*) - count(distinct (symbol, d)) from preds) select name, n = 0 as passed, n from q"
    s["l7_review_sections"] = f"""with {CANDS}, b as (select symbol, cast(date_trunc('month', d) as date) as month, max(cheap) as cheap, max(quality) as quality, max(momentum) as momentum, case when max(num) % 3 = 0 then 'C' else 'B' end as tier from cands group by 1, 2), l as (select symbol, month, tier, 'cheap' as s, cheap as v from b union all select symbol, month, tier, 'quality', quality from b union all select symbol, month, tier, 'momentum', momentum from b),
        t as (select * from l where v is not null qualify row_number() over (partition by month, s order by v desc, symbol) <= 5), q as (select symbol, month, tier, string_agg(s, ',' order by s) as sections, count(*) as n from t group by 1, 2, 3) select *, case when n >= 3 or tier = 'C' then 'high' when n = 2 then 'medium' else 'low' end as priority from q"""
    parts = ("cheap", "quality", "catalyst", "momentum", "sentiment")
    s["l7_review_stats"] = f"""with {CANDS} select cast(date_trunc('month', d) as date) as month, count(*) as n, {', '.join(f"round(avg(case when {x} is null then 1.0::double else 0 end), 6) as no_{x}" for x in parts)}, round(avg(case when {' + '.join(f"(case when {x} is null then 0 else 1 end)" for x in parts)} < 3 then 1.0::double else 0 end), 6) as low_confidence, {', '.join(f"count(*) filter (cheap >= {10 * i} and cheap < {10 * i + 10}) as tens_{i}" for i in range(11))} from cands group by 1"""
    s["l11_guard_hits"] = f"with {CANDS}, q as (select symbol, cast(date_trunc('month', d) as date) as month, bool_or(num % 4 = 0) as a, bool_or(num % 4 <> 0 and num % 5 = 0) as b from cands group by 1, 2) select symbol, month, concat_ws('|', case when a then 'flagged' end, case when b then 'low_confidence' end) as hits from q"
    return s
