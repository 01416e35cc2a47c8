"""SQL for the further joins, the evaluation of predictions and table upkeep."""

from __future__ import annotations

from .oracle import BARS, FILINGS, LAG, PREDS, TICKS, W, w
from .oracle_intraday import HOURS
from .oracle_paths import CANDS, _exit, _path

CANDS_ONLY = CANDS[len(BARS) + 2:]  # beside bars that are there already
SCORED = f"{PREDS}, sc as (select * from preds where hit is not null), rt as (select * from preds where ret is not null)"
STATS = "count(*) as n, avg(case when ret > 0 then 1.0 else 0.0 end) as win_rate, avg(ret) as mean_ret, quantile_cont(ret, 0.5) as median_ret, sum(case when ret > 0 then ret end) / sum(case when ret < 0 then -ret end) as profit_factor"
SHARPE = "avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252)"


def all_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["a9_replace_slice"] = f"with {BARS} select symbol, d, case when d = date '1999-06-01' then trades + 1000 else trades end as trades from bars"
    s["a11_roster_parity"] = f"with {HOURS} select symbol, h, case when hour(h) = 7 then 'missing' else 'mismatch' end as problem from hours where hour(h) in (7, 9)"
    s["a12_infer_gaps"] = f"with {HOURS}, f as (select symbol, cast(h as date) as day, min(h) as lo, max(h) as hi from hours group by 1, 2), g as (select a.symbol, a.day, (select max(hi) from f b where b.symbol = a.symbol and b.day < a.day and day(b.day) % 9 <> 0) as p, (select min(lo) from f b where b.symbol = a.symbol and b.day > a.day and day(b.day) % 9 <> 0) as q from f a where day(a.day) % 9 = 0) select symbol, day, coalesce(p, q) as gap_start, coalesce(q, p) as gap_end from g"
    s["c2_left_lookup"] = f"with {BARS}, x as (select concat('S', cast(s_suppkey % 10 as varchar)) as symbol, round(sum(s_acctbal), 2) as cap from supplier group by 1) select b.symbol, b.d, x.cap from bars b left join x on x.symbol = b.symbol and x.cap > 0"
    s["c3_cross_scalar"] = f"with {HOURS} select symbol, max(h) as own, cast(date_diff('hour', max(h), (select max(h) from hours)) as int) as hours_behind from hours group by 1"
    s["c7_row_range_having"] = f"with {PREDS}, n as (select *, row_number() over {W} as k from bars) select p.symbol, p.d, round(max(m.high), 8) as top, round(min(m.low), 8) as bottom from preds p join n on n.symbol = p.symbol and n.d = p.d join n m on m.symbol = n.symbol and m.k > n.k and m.k <= n.k + 10 where p.prob >= 0.8 group by 1, 2 having count(*) = 10"
    s["c10_attach_series"] = f"with {BARS}, x as (select cast(date_trunc('week', o_orderdate) as date) as t, avg(o_totalprice) as v from orders where o_orderstatus = 'F' group by 1), y as (select t, v, v - lag(v) over (order by t) as step from x), ds as (select distinct d from bars), m as (select d, (select max(t) from y where t <= d) as t from ds) select b.symbol, b.d, round(y.v, 9) as level, round(case when y.t = b.d then y.step end, 9) as step from bars b left join m on m.d = b.d left join y on y.t = m.t"
    s["c15_cluster"] = f"with {BARS}, e as (select symbol, d, cast(substr(symbol, 2) as int) % 2 as grp from (select symbol, d, {LAG(1)} as r from bars) where r > 3) select a.symbol, a.d, count(*) as others from e a join e b on b.grp = a.grp and b.symbol <> a.symbol and b.d between a.d - 3 and a.d + 3 group by 1, 2 having count(*) >= 2"
    s["c16_near"] = f"with {BARS}, {FILINGS} select symbol, d, trades from bars b where exists (select 1 from filings f where f.symbol = b.symbol and f.form = '8-K' and f.filing_date between b.d - 7 and b.d + 7)"
    s["c17_point_lookup"] = f"with {PREDS}, x as (select symbol, d, round({LAG(60)}, 6) as ret_60 from bars) select p.symbol, p.d, x.ret_60 from preds p join x on x.symbol = p.symbol and x.d = p.d where p.prob >= 0.95 and x.ret_60 is not null"
    s["c18_interval_overlap"] = f"with {HOURS}, g as (select h as a from hours where symbol = 'U3' and hour(h) = 5) select symbol, h, exists (select 1 from g where a <= hours.h + interval 6 hour and a + interval 30 minute >= hours.h) as overlaps from hours"
    s["c20_pair_spread"] = f"with {BARS} select a.d, round(a.close - b.close, 7) as spread from bars a join bars b on b.d = a.d and b.symbol = 'S2' where a.symbol = 'S1'"
    s["c22_leak_check"] = f"with {PREDS}, r as (select model, min(d) + 30 as e from preds group by 1) select p.model, count(*) as n, max(p.d) as last_day from preds p join r on r.model = p.model and p.d <= r.e group by 1"
    s["c24_latest_mark"] = f"with {PREDS}, m as (select symbol, arg_max(close, d) as mark from bars group by 1) select p.symbol, round(sum((mark - close) * (year(d) - 1990)), 2) as unrealised, count(*) as n from preds p join m on m.symbol = p.symbol where prob >= 0.95 group by 1"
    up = "over (partition by symbol order by event_id)"
    s["c25_merge_last_seen"] = f"with {TICKS}, q as (select symbol, event_id, price, last_value(case when event_id % 3 = 0 then price end ignore nulls) {up} as a, last_value(case when event_id % 3 = 1 then price end ignore nulls) {up} as b, last_value(case when event_id % 3 = 2 then price end ignore nulls) {up} as c from ticks) select symbol, event_id, round(a, 6) as last_mark, round(b, 6) as last_index, round(c, 6) as last_funding from q where event_id % 3 = 0 and a is not null and b is not null and c is not null"
    reasons = ("tp", "sl", "stop_loss", "trailing", "time", "data_gap")
    s["d8_run_summary"] = f"""with {_path(10)}, {_exit("case when low <= entry * 0.7 then 'sl' when high >= entry * 1.5 then 'tp' end", 'case when low <= entry * 0.7 then entry * 0.7 else entry * 1.5 end')},
        z as (select cast(year(d) as int) as run, d, cast(d + cast(bar as int) as date) as e, bar, reason, (bar % 3) * 0.0001::double as funding, ret - 0.0007::double - 0.002::double + (bar % 3) * 0.0001::double as net from x), dy as (select run, e, sum(net) as pnl from z group by 1, 2),
        eq as (select run, e, pnl, 1 + sum(pnl) over (partition by run order by e) as q from dy), dd as (select run, q / max(q) over (partition by run order by e) - 1 as v from eq), dm as (select run, min(v) as max_drawdown from dd group by 1),
        ds as (select run, count(*) as n_days, case when stddev_samp(pnl) > 0 then avg(pnl) / stddev_samp(pnl) * sqrt(252) end as sharpe from dy group by 1),
        a as (select run, count(*) as n, sum(net) as total, case when max(e) > min(d) then sum(net) * 365.0 / date_diff('day', min(d), max(e)) end as annual, avg(case when net > 0 then 1.0::double else 0 end) as hit_rate, avg(net) filter (net > 0) as avg_winner, avg(net) filter (net <= 0) as avg_loser, case when count(*) filter (net < 0) > 0 then coalesce(sum(net) filter (net > 0), 0) / -sum(net) filter (net <= 0) when count(*) filter (net > 0) > 0 then 'infinity'::double end as profit_factor, avg(bar) as avg_holding, {', '.join(f"avg(case when reason = '{x}' then 1.0::double else 0 end) as pct_{x}" for x in reasons)}, count(*) * 0.0007::double as fees, sum(funding) as funding, count(*) * 0.002::double as slippage from z group by 1)
        select run, n, n_days, {', '.join(f'round({c}, 5) as {c}' for c in ('total', 'annual', 'hit_rate', 'avg_winner', 'avg_loser', 'profit_factor', 'avg_holding', *(f'pct_{x}' for x in reasons), 'fees', 'funding', 'slippage', 'sharpe', 'max_drawdown'))} from a join ds using (run) join dm using (run)"""
    s["d13_calibration_runs"] = f"with {SCORED}, q as (select least(9, cast(floor(prob * 10 + 1e-9) as int)) as bucket, count(*) as n, count(*) filter (hit) as k from sc group by 1), z as (select bucket, case when n >= 10 and abs(k / n * 100 - (bucket * 10 + 5)) > 10 then sign(k / n * 100 - (bucket * 10 + 5)) end as side from q), g as (select side, bucket, bucket - row_number() over (partition by side order by bucket) as g from z where side is not null), h as (select side, min(bucket) as first, count(*) as length from g group by side, g.g) select cast(side as double) as side, first, length, cast(row_number() over (order by length desc, first) as int) as place from h"
    s["d14_tolerance_checks"] = f"with {SCORED}, m as (select *, cast(hit as double) as y, d > max(d) over (partition by model) - 30 as late from sc), q as (select model, count(*) as n, round(avg(y) filter (prob >= 0.6) / nullif(avg(y), 0), 6) as lift, round(avg(y) filter (late and prob >= 0.6) / nullif(avg(y) filter (late), 0), 6) as lift_30 from m group by 1), k as (select *, coalesce(lift between 0.75 and 1.25, false) as rate_ok, coalesce(lift_30 >= 1.3, false) as lift_ok, n >= 200 as sample_ok from q) select *, case when not sample_ok then 'INTERIM' when rate_ok and lift_ok then 'PASS' else 'FAIL' end as verdict from k"
    s["d15_accumulation_eta"] = f"with {FILINGS}, q as (select form, count(*) as n, count(*) filter (filing_date > date '2001-07-31' - 7) as week from filings group by 1) select form, n, week, round((1e6 - n) / nullif(week / 7.0, 0), 3) as days_left from q"
    s["d21_median_impute"] = f"with {BARS}, q as (select symbol, d, {LAG(60)} as x, case when day(d) % 3 <> 0 then volume end as y from bars), m as (select quantile_cont(x, 0.5) as mx, quantile_cont(y, 0.5) as my from q where d < date '1998-01-01') select symbol, d, case when d < date '1998-01-01' then 'train' else 'test' end as slice, round(coalesce(x, mx), 6) as x, round(coalesce(y, my), 6) as y from q, m"
    s["d25_coverage_ratio"] = f"with {BARS}, q as (select d, count(*) as n from bars group by 1), p as (select d, n, n / avg(n) over (order by d rows between 5 preceding and 1 preceding) as ratio from q) select d, n, round(ratio, 6) as ratio, case when ratio >= 0.9 then 'ok' when ratio >= 0.7 then 'warn' when ratio is not null then 'fail' end as state from p"
    s["d26_freshness"] = f"""with {BARS}, {FILINGS}, q as (select 'filings' as "table", symbol, form, max(filing_date) as last_day, 2 as a, 30 as b from filings group by 1, 2, 3 union all select 'bars', symbol, 'bar', max(d), 980, 984 from bars group by 2), r as (select *, cast(date_diff('day', last_day, date '2001-08-02') as int) as age from q)
        select "table", symbol, form, age, case when age <= a then 'fresh' when age <= b then 'stale' else 'missing' end as state from r"""
    dims = {"bucket": "case when prob >= 0.8 then '80+' when prob >= 0.7 then '70-79' when prob >= 0.6 then '60-69' when prob >= 0.5 then '50-59' else '<50' end", "tier": "case when prob >= 0.75 then 'A' when prob >= 0.6 then 'B' else 'C' end", "horizon": "horizon", "model": "cast(model as varchar)"}
    s["d27_outcome_by"] = f"with {SCORED} " + " union all ".join(f"select '{k}' as dimension, {v} as value, count(*) as n, count(*) filter (hit) as hits, round(avg(ln(1 + ret)), 6) as mean_ret, round(avg(cast(hit as double)), 6) as rate from sc group by 2" for k, v in dims.items())
    s["d27_component_means"] = f"with {SCORED}, {CANDS_ONLY} select hit, count(*) as n, {', '.join(f'round(avg({c}), 6) as {c}' for c in ('cheap', 'quality', 'catalyst', 'momentum', 'sentiment', 'risk'))}, round(avg(ln(1 + ret)), 6) as ret from cands c join sc on sc.symbol = c.symbol and sc.d = c.d group by 1"
    s["d27_feature_coverage"] = f"with {BARS}, {CANDS_ONLY}, q as (select symbol, cast(year(d) as int) as year, count(*) * 6 as features, count(cheap) + count(quality) + count(catalyst) + count(momentum) + count(sentiment) + count(risk) as present from cands group by 1, 2) select *, round(present * 100.0 / features, 6) as pct from q"
    s["d28_two_sample_t"] = f"with {SCORED}, q as (select ln(1 + ret) as x, prob >= 0.5 as a from rt), m as (select count(*) filter (a) as na, count(*) filter (not a) as nb, avg(x) filter (a) as ma, avg(x) filter (not a) as mb, var_samp(x) filter (a) as va, var_samp(x) filter (not a) as vb from q) select na, nb, round(ma, 5) as ma, round(mb, 5) as mb, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 5) as t from m"
    s["d29_quintile_spread"] = f"with {SCORED}, e as (select quantile_cont(prob, [0.2, 0.4, 0.6, 0.8]) as e from rt), q as (select len(list_filter(e.e, lambda v: v < prob)) + 1 as bin, ln(1 + ret) as x from rt, e), g as (select cast(bin as int) as bin, count(*) as n, avg(x) as mean, var_samp(x) as v from q group by 1), z as (select a.mean - b.mean as spread, sqrt(a.v / a.n + b.v / b.n) as se from g a, g b where a.bin = 1 and b.bin = 5) select bin, n, round(mean, 6) as mean, round(spread, 6) as spread, round(spread / nullif(se, 0), 5) as t from g left join z on true"
    s["d33_monthly_regime"] = f"with {SCORED}, m as (select date_trunc('month', d) as mo, arg_max(close, d) / arg_min(close, d) - 1 as ch from bars where symbol = 'S0' group by 1) select case when ch > 0.05 then 'bull' when ch < -0.05 then 'bear' else 'neutral' end as regime, count(*) as n, round(avg(cast(hit as double)), 6) as rate, round(avg(ret), 5) as mean_ret from sc join m on m.mo = date_trunc('month', d) group by 1"
    s["d34_friction_sweep"] = f"with {SCORED}, p as (select cast(c as double) as cost, d, ret - c as ret from rt, (select unnest([0.0, 0.25, 0.5, 1.0]::double[]) as c)), b as (select cost, {SHARPE} as sharpe from (select cost, d, sum(ret) as pnl from p group by 1, 2) group by 1), a as (select cost, {STATS} from p group by 1) select a.cost, n, round(win_rate, 5) as win_rate, round(mean_ret, 5) as mean_ret, round(sharpe, 5) as sharpe from a join b on b.cost = a.cost"
    s["d35_leave_one_out"] = f"with {SCORED}, q as (select d, cast(date_trunc('month', d) as date) as mo, sum(ln(1 + ret)) as pnl from rt group by 1, 2), t as (select {SHARPE} as whole from q), o as (select m.mo as month, {SHARPE} as sharpe from (select distinct mo from q) m join q on q.mo <> m.mo group by 1) select month, round(sharpe, 5) as sharpe, round(sharpe / whole, 5) as ratio from o, t"
    others = {"model": "horizon threshold", "horizon": "model threshold", "threshold": "model horizon"}
    near = " union all ".join(
        f"select '{a}' as axis, cast(q.{a} as varchar) as value, q.{a} = b.{a} as base, q.n_days, q.sharpe from q, b where " + " and ".join(f"q.{o} = b.{o}" for o in rest.split()) for a, rest in others.items()
    )
    every = " union ".join(f"select '{a}' as axis, cast({a} as varchar) as value from q" for a in others)
    s["d36_sensitivity"] = f"""with {SCORED}, x as (select model, horizon, threshold, d, sum(ret) as pnl from rt, (values (0.2::double), (0.4), (0.6), (0.8)) v(threshold) where prob >= threshold group by all),
        q as (select model, horizon, threshold, count(*) as n_days, round({SHARPE}, 6) as sharpe from x group by 1, 2, 3),
        b as (select * from q order by sharpe desc nulls last, model, horizon, threshold limit 1), near as ({near}), every as ({every})
        select axis, value, coalesce(base, false) as base, n_days, sharpe from every left join near using (axis, value)"""
    covered = lambda table, today, share: f"""
        select source, latest, n, gap, expected,
            case when gap <= 2 then covered end as covered,
            case when gap > 2 then 'stale' when covered is null then 'uncovered' when covered = latest then 'fresh' else 'degraded' end as state
        from (select source, latest, own as n, (select count(*) from range(latest + 1, date '{today}' + 1, interval 1 day) t(x) where isodow(x) < 6) as gap, expected, max(day) filter (c >= expected and day >= latest - 11
                and (select count(*) from range(day + 1, latest + 1, interval 1 day) t(x) where isodow(x) < 6) <= 1) as covered
            from (select *, coalesce(cast(round_even({share} * (select avg(h.c) from (select c from {table} o where o.source = f.source and o.day < f.latest order by o.day desc limit 30) h), 0) as bigint), own) as expected
                from (select *, max(day) over (partition by source) as latest, arg_max(c, day) over (partition by source) as own from {table}) f)
            group by all)"""  # noqa: E731
    s["d25_covered_day"] = f"""with {BARS}, {FILINGS},
        a as (select concat('filings ', form) as source, filing_date as day, count(*) as c from filings where filing_date <= date '2001-07-31' group by 1, 2),
        z as (select concat('bars of ', month(d)) as source, d as day, count(*) as c from bars where d <= date '2000-03-31' group by 1, 2)
        {covered('a', '2001-08-01', 0.5)} union all {covered('z', '2000-04-03', 1.0)}"""
    s["d36_config_ranking"] = f"with {SCORED}, q as (select model, horizon, round({SHARPE}, 6) as sharpe from (select model, horizon, d, sum(ret) as pnl from rt group by 1, 2, 3) group by 1, 2) select model, horizon, sharpe, cast(row_number() over (order by sharpe desc nulls last, model, horizon) as int) as place from q qualify place <= 10"
    s["d37_recurring_keys"] = f"with {PREDS} select symbol, model, cast(count(distinct d) as int) as n, string_agg(cast(d as varchar), ',' order by d) as days from preds group by 1, 2 having count(distinct d) > 1"
    tier = lambda v: f"case when {v} >= 75 then 'A' when {v} >= 60 then 'B' when {v} >= 45 then 'C' else 'Reject' end"
    s["d38_shadow_cap"] = f"with {CANDS}, q as (select symbol, cast(date_trunc('month', d) as date) as month, greatest(-5.0, least(5.0, sum(num % 9 - 4))) as adj, max(num * 23 % 101) as sc from cands group by 1, 2) select symbol, month, cast(adj as double) as adj, {tier('(sc + adj)')} as tier, case when {tier('sc')} = {tier('(sc + adj)')} then 'same' when adj > 0 then 'up' else 'down' end as move from q"
    s["d39_rule_aggregates"] = f"with {BARS}, q as (select symbol, d, close, ln(close / lag(close) over {W}) as lr, {LAG(1)} as r, max(close) over {w('1 following', '5 following')} / close - 1 as f from bars), p as (select *, case when count(lr) over {w('19 preceding', 'current row')} >= 2 then stddev_samp(lr) over {w('19 preceding', 'current row')} end as vol from q) select case when r > 1 then 'up' when r < -0.5 then 'down' else 'quiet' end as rule, count(*) as n, round(avg(case when f >= 0.5 then 1.0 else 0.0 end), 6) as rate, round(avg(ln(1 + f) / vol), 5) as mean_norm from p where vol > 0 and f is not null group by 1"
    s["d40_promotion_gate"] = f"with {SCORED}, q as (select model, avg(cast(hit as double)) as rate from sc group by 1), p as (select model, rate, lag(rate) over (order by model) as old from q) select model, round(rate, 6) as rate, round(old, 6) as old, case when old is null or old = 0 then true else round(rate - 0.9::double * old, 9) >= 0 end as passed from p"
    five = " + ".join(f"(case when {c} is null then 0 else 1 end)" for c in ("cheap", "quality", "catalyst", "momentum", "sentiment"))
    s["d40_legacy_gates"] = f"""with {SCORED}, {CANDS_ONLY}, k as (select hit, rank() over (order by prob) + (count(*) over (partition by prob) - 1) / 2.0 as r from sc where model = (select max(model) from sc)),
        g as (select 'sample_size' as gate, count(*)::double as value, 100.0::double as bound, true as least from sc union all select 'discrimination', (sum(case when hit then r end) - count(*) filter (hit) * (count(*) filter (hit) + 1) / 2.0) / nullif(count(*) filter (hit) * count(*) filter (not hit), 0), 0.55, true from k
        union all select 'flawed_reviews', avg(case when num % 8 in (1, 2, 3, 5) then 1.0::double else 0 end), 0.3, false from cands union all select 'thin_features', avg(case when {five} < 3 then 1.0::double else 0 end), 0.4, false from cands
        union all select 'concentration', max(n) / sum(n), 0.5, false from (select count(*) as n from cands group by cast(substr(symbol, 2) as int) % 3) union all select 'stability', count(distinct model), 5.0, true from sc)
        select gate, round(value, 6) as value, bound, coalesce(case when least then value >= bound else value <= bound end, true) as passed from g"""
    s["d43_fold_stability"] = f"with {SCORED}, k as (select model, hit, rank() over (partition by model order by prob) + (count(*) over (partition by model, prob) - 1) / 2.0 as r from sc), a as (select model, (sum(case when hit then r end) - count(*) filter (hit) * (count(*) filter (hit) + 1) / 2.0) / nullif(count(*) filter (hit) * count(*) filter (not hit), 0) as auc from k group by 1), b as (select model, min(d) as first_day, max(d) as last_day, count(*) as n, avg(cast(hit as double)) as base, avg(cast(hit as double)) filter (prob >= 0.8) as top, avg((prob - cast(hit as double)) ** 2) as brier from sc group by 1), j as (select b.*, a.auc from b join a on a.model = b.model) select model, first_day, last_day, n, round(base, 6) as base, round(top, 6) as top, round(brier, 6) as brier, round(auc, 6) as auc, round(regr_slope(auc, model) over (), 6) as auc_trend, round(regr_slope(brier, model) over (), 6) as brier_trend from j"
    return s
