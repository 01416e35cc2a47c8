"""SQL for the decision ladders and the trade paths, written apart from them."""

from __future__ import annotations

from .oracle import BARS, FILINGS, PREDS, TICKS, W, w

CANDS = f"""{BARS}, cands0 as (select symbol, d, close, trades, cast(volume as bigint) as num from bars),
cands as (select *, {', '.join(f"case when num % {m} <> 0 then cast(num * {k} % 101 as double) end as {c}" for c, m, k in (('cheap', 7, 3), ('quality', 5, 7), ('catalyst', 4, 11), ('momentum', 3, 13), ('sentiment', 2, 17), ('risk', 9, 19)))} from cands0)"""
RET1 = f"(close / lag(close) over {W} - 1)"


def _path(days: int, extra: str = "", where: str = "") -> str:
    """Rows t(symbol, d, entry, k, day, open, high, low, close, gap): one per day until three bars in a row are missing."""
    return f"""{PREDS}, tr as (select symbol, d, close as entry{extra} from preds {where or 'where prob >= 0.9'}),
    p0 as (select tr.*, cast(k as int) as k, cast(tr.d + cast(k as int) as date) as day from tr, range({days + 1}) r(k)),
    p1 as (select p0.*, b.open as o, b.high as h, b.low as l, b.close as c from p0 left join bars b on b.symbol = p0.symbol and b.d = p0.day),
    p2 as (select p1.*, (select max(q.k) from p1 q where q.symbol = p1.symbol and q.d = p1.d and q.k <= p1.k and (q.k = 0 or q.c is not null)) as seen from p1),
    p3 as (select *, min(case when k - seen > 2 then seen end) over (partition by symbol, d) as cut from p2),
    t as (select x.symbol, x.d, x.entry, x.k, x.day, case when x.k = 0 or x.c is null then y.v else x.o end as open, case when x.k = 0 or x.c is null then y.v else x.h end as high, case when x.k = 0 or x.c is null then y.v else x.l end as low, y.v as close, x.cut is not null as gap{''.join(', x.' + e.split()[-1] for e in extra.split(',')[1:])}
      from p3 x join (select symbol, d, k, case when k = 0 then entry else c end as v from p2) y on y.symbol = x.symbol and y.d = x.d and y.k = x.seen where x.cut is null or x.k <= x.cut),
    pk as (select *, greatest(entry, max(high) over (partition by symbol, d order by k rows between unbounded preceding and 1 preceding)) as peak from t)"""


def _exit(reason: str, price: str, src: str = "pk", key: str = "symbol, d") -> str:
    """First bar after entry with a reason, else the last close."""
    return f"""f as (select *, case when k > 0 then {reason} end as why, {price} as fill from {src}),
    g as (select {key}, first(entry) as entry, min(case when why is not null then k end) as at, max(k) as last_k, bool_or(gap) as gap from f group by {key}),
    x as (select {', '.join('g.' + c.strip() for c in key.split(','))}, g.entry, coalesce(f.why, case when g.gap then 'data_gap' else 'time' end) as reason, coalesce(g.at, g.last_k) as bar, case when g.at is not null then f.fill else f.close end / g.entry - 1 as ret from g join f on {' and '.join(f'f.{c.strip()} = g.{c.strip()}' for c in key.split(','))} and f.k = coalesce(g.at, g.last_k))"""


OUT = "select symbol, d, reason, bar, round(ret, 5) as ret from x"
TIER = "case when coalesce({r}, 0) > 75 then 'Reject' when {o} < 2 then 'Incomplete' when {t} >= 75 and coalesce({c}, 0) >= 50 and coalesce({r}, 0) <= 50 and {v} >= 0.8 then 'A' when {t} >= 60 and {v} >= 0.65 then 'B' when {t} >= 45 then 'C' else 'Reject' end"


def all_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["b6_tier_assign"] = f"with {CANDS} select symbol, d, {TIER.format(r='risk', o='trades % 6', t='num * 23 % 101', c='catalyst', v='trades % 11 / 10.0')} as tier from cands"
    s["b9_miss_classify"] = f"""with {CANDS}, q as (select symbol, d, num % 11 <> 0 as in_u, quality as score, case num % 5 when 0 then 'A' when 1 then 'C' when 2 then 'Incomplete' when 3 then 'Reject' end as tier, trades % 2 = 0 as ev, case num % 8 when 0 then 5 when 1 then 4 when 2 then 3 when 3 then 3 when 4 then 2 when 5 then 1 when 6 then 1 else 0 end + case num % 3 when 0 then 0.3 when 1 then 0.1 else 0 end as p from cands),
    l as (select *, case when not in_u then 'universe_miss' when score is null then 'unscored_mover' when score >= 40 and score < 45 then 'near_threshold' when tier in ('A', 'B') then 'scored_correct' when tier = 'C' then 'scored_missed' else 'true_miss' end as label from q)
    select symbol, d, label, case label when 'universe_miss' then 'universe_gap' when 'unscored_mover' then 'data_gap' when 'near_threshold' then 'near_threshold' when 'true_miss' then case when tier = 'Incomplete' then 'data_gap' else 'scoring_blind_spot' end when 'scored_missed' then case when ev then 'scoring_blind_spot' else 'catalyst_missed' end else 'unknown' end as hint, round(cast(p + case when label = 'near_threshold' then 0.2 else 0 end as double), 6) as priority from l"""
    s["b12_attribution_label"] = f"with {BARS}, x as (select symbol, d, {RET1} / 10 as own from bars), q as (select a.symbol, a.d, a.own, b.own as etf from x a left join x b on b.symbol = 'S0' and b.d = a.d) select symbol, d, case when own is null or etf is null then 'peer_cluster_only_no_etf_data' when own * etf > 0 and abs(etf) >= 0.01 and abs(own - etf) < 0.03 then 'sector_etf_confirmed' when abs(own - etf) >= 0.03 then 'ticker_outperformed_sector' when own * etf > 0 and abs(etf) >= 0.01 then 'sector_signal_underweighted' else 'peer_cluster_only_no_etf_data' end as label from q"
    s["b13_symbol_guard"] = "with q as (select c_custkey, concat(upper(substr(c_name, 1, 4)), cast(c_custkey % 50 as varchar), case c_custkey % 3 when 0 then 'USDT' when 1 then 'usdt' else '-USDT' end) as symbol from customer) select * from q where regexp_full_match(symbol, '[A-Z0-9]+USDT') and symbol not in ('CUST3USDT', 'CUST6USDT')"
    s["b14_instrument_classify"] = """with q as (select p_partkey, upper(concat_ws(' ', p_name, case p_partkey % 5 when 0 then 'growth fund' when 1 then 'ETF' when 2 then 'ADR' when 3 then 'warrant' end)) as n, concat('T', case when p_partkey % 7 = 0 then '.' end, cast(p_partkey * 7 as varchar)) as t from part),
    f as (select p_partkey, t, n, regexp_matches(n, 'ETF|ISHARES|SPDR|VANGUARD|INVESCO|WISDOMTREE|POWERSHARES|PROSHARES|DIREXION|GRANITESHARES') as is_etf, regexp_matches(n, ' FUND|TRUST|REIT|BDC|MLP |PARTNERSHIP') as is_fund, regexp_matches(n, 'ADR| ADS') as is_adr from q)
    select p_partkey, is_etf, is_fund, is_adr, not is_etf and not is_fund and length(t) <= 5 and not regexp_matches(t, '[.+-]') and not regexp_matches(n, 'WARRANT|UNIT SER|PREFERRED|NOTE DUE|BOND DUE|DEP SHS|DEP SHARES|DEPOSITARY|ADR') as kept from f"""
    s["b15_industry_flags"] = "with k as (select concat('S', cast(o_custkey % 10 as varchar)) as symbol, bool_or(o_orderstatus = 'P' and o_totalprice > 300000) as ins, bool_or(o_orderstatus = 'P' and o_totalprice > 250000) as bank from orders group by 1), n as (select s_suppkey, concat('S', cast(s_suppkey % 10 as varchar)) as symbol from supplier) select s_suppkey, case when k.ins then 'insurer' when k.bank then 'bank' when s_suppkey % 4 = 1 then 'insurer' when s_suppkey % 4 = 0 then 'bank' else 'other' end as kind from n left join k on k.symbol = n.symbol"
    s["b16_period_alignment"] = f"with {FILINGS}, q as (select accession, form, filing_date as a, lag(filing_date, 40) over v as b, lag(form, 40) over v as pf from filings window v as (partition by symbol order by filing_date, accession)), k as (select *, abs(a - b) as g, form in ('10-K', '10-Q') and pf in ('10-K', '10-Q') as byf from q where b is not null), p as (select *, case when byf then case when form = pf then case form when '10-K' then 'annual' else 'quarterly' end end when g between 335 and 395 then 'annual' when g between 75 and 105 then 'quarterly' end as period from k) select accession, cast(g as int) as gap_days, period as period_type, case when byf then 'form' else 'gap' end as method, case when period is null then 'mismatched' else 'aligned' end as status from p"
    s["b18_market_clock"] = f"""with {TICKS}, q as (select event_id, ts, cast(ts as date) as day, isodow(ts) as wd from ticks),
        hol as (select distinct cast(date_trunc('month', day) as date) + 14 as h from q),
        bd as (select b, row_number() over (order by b) as k from (select cast(date '2023-12-01' + cast(i as int) as date) as b from range(0, 500) r(i)) where isodow(b) <= 5 and b not in (select h from hol)),
        st as (select day, (select min(k) from bd where b >= day) + 10 as k from (select distinct day from q))
        select event_id, (select b from bd join st using (k) where st.day = q.day) as settles, wd = 6 or (wd = 5 and hour(ts) >= 22) or (wd = 7 and hour(ts) < 22) as closed, cast(day - cast((wd + 2) % 7 as int) as timestamp) + interval 21 hour as close_floor, cast(day - case wd when 1 then 3 when 7 then 2 else 1 end as date) as prev_weekday, cast((select count(*) from range(0, 400) r(i) where date '2023-12-20' + cast(i as int) <= day and isodow(date '2023-12-20' + cast(i as int)) <= 5) as int) as weekdays from q"""
    s["b19_pct_move"] = f"with {PREDS} select symbol, d, round(case when prob < 0.5 and ret is not null then ret * 100 when close > 0 then (arg_max(close, d) over (partition by symbol) / close - 1) * 100 end, 5) as move from preds"
    s["b20_catalyst_adjustment"] = f"""with {CANDS}, q as (select symbol, d, case num % 4 when 0 then 1.0 when 1 then 0.6 when 2 then 0.8 else 0.65 end as scope, case num % 3 when 0 then 5.0 when 1 then 3.0 else 1.5 end * case num % 5 when 0 then 1 when 1 then -1 when 2 then 0 when 3 then 1 else -1 end as st, least(1.0, trades % 13 / 10.0) as conf, num % 6 in (1, 4) or num % 17 = 0 as bad, case when risk is null then 1.0 else greatest(0.5, 1 - risk / 200.0) end as rk, case when num % 3 = 0 then case when num % 8 < 2 then 0.2 when num % 8 < 5 then 0.55 else 0.9 end else greatest(0.0, 1 - (num % 120) / 90.0) end as mk from cands),
    a as (select symbol, d, case when bad then 0.0 else greatest(-5.0, least(5.0, cast(st as double) * conf * cast(scope as double) * mk * rk)) end as adj from q) select symbol, d, round(adj, 11) as adjustment, case when abs(adj) >= 3.5 then 'high' when abs(adj) >= 1.5 then 'medium' when abs(adj) > 0 then 'low' else 'none' end as impact from a"""
    s["b23_confidence"] = f"with {CANDS}, q as (select symbol, d, round(cast(case when cheap is null then 0 else 0.3 end + case when quality is null then 0 else 0.25 end + case when catalyst is null then 0 else 0.25 end + case when momentum is null then 0 else 0.1 end + case when sentiment is null then 0 else 0.1 end as double), 6) as c from cands) select symbol, d, case when c >= 0.8 then 'high' when c >= 0.5 then 'medium' when c > 0 then 'low' else 'none' end as confidence from q"
    rank = f"(select symbol, 5 * rank() over (order by avg(close * volume) desc) as rk from bars where d <= date '2000-06-30' and d > date '2000-06-30' - 90 group by 1)"
    s["b24_cost_tier"] = f"with {BARS} select symbol, case when rk <= 10 then 1 when rk <= 30 then 2 else 3 end as tier, round(cast(0.0007 + 2 * case when rk <= 10 then 0.0002 when rk <= 30 then 0.0005 else 0.001 end as double), 6) as cost from {rank}"
    s["b25_contract_to_coin"] = f"with {TICKS} select event_id, case when event_id % 7 <= 4 then round(qty / 1000, 9) end as coins from ticks"
    parts = ("cheap", "quality", "catalyst", "momentum", "sentiment", "risk")
    weight = {"cheap": 0.3, "quality": 0.25, "catalyst": 0.25, "momentum": 0.1, "sentiment": 0.1}
    s["d1_component_scores"] = f"with {CANDS}, a as (select symbol, cast(year(d) as int) as year, cast(month(d) as int) as month, {', '.join(f'avg({p}) as {p}' for p in parts)} from cands group by all) select symbol, year, month, {', '.join(f'round({p}, 6) as {p}' for p in parts)}, round(greatest(0.0, least(100.0, {' + '.join(f'{x}::double * coalesce({p}, 0)' for p, x in weight.items())} - 0.2::double * coalesce(risk, 50))), 6) as total, round(cast({' + '.join(f'case when {p} is null then 0 else {x} end' for p, x in weight.items())} as double), 6) as coverage, {' + '.join(f'cast({p} is not null as int)' for p in weight)} as observed from a where coalesce({', '.join(parts)}) is not null"
    s["k1_path_expand"] = f"with {_path(10)} select symbol, d, k, day, round(high, 8) as high, round(low, 8) as low, round(close, 8) as close, gap from t"
    s["k2_fixed_tp"] = f"with {_path(10)}, {_exit('''case when high >= entry * 1.5 then 'tp' end''', 'entry * 1.5')} {OUT}"
    s["k3_tp_sl"] = f"with {_path(10)}, {_exit('''case when low <= entry * 0.7 then 'sl' when high >= entry * 1.5 then 'tp' end''', 'case when low <= entry * 0.7 then entry * 0.7 else entry * 1.5 end')} {OUT}"
    atr = f"(select symbol, d, least(avg(tr) over {w('13 preceding', 'current row')} / close, 0.4) as atr from (select symbol, d, close, greatest(high - low, abs(high - lag(close) over {W}), abs(low - lag(close) over {W})) as tr from bars))"
    s["k4_tp_atr_sl"] = f"with {_path(10, ', a.atr', f'join {atr} a using (symbol, d) where prob >= 0.9 and a.atr is not null').replace('x.a.atr', 'x.atr')}, {_exit('''case when low <= entry * (1 - 1.5 * atr) then 'sl' when high >= entry * 1.5 then 'tp' end''', 'case when low <= entry * (1 - 1.5 * atr) then entry * (1 - 1.5 * atr) else entry * 1.5 end')} {OUT}"
    trail = "peak >= entry * 1.1 and peak > entry and low <= peak - (peak - entry) * 0.3"
    s["k5_trailing"] = f"with {_path(10)}, {_exit(f'''case when {trail} then 'trailing' end''', 'peak - (peak - entry) * 0.3')} {OUT}"
    s["k6_tiered"] = f"with {_path(10)}, h as (select *, min(case when k > 0 and high >= entry * 1.5 then k end) over (partition by symbol, d) as tp from t), hp as (select symbol, d, entry, k, day, open, high, low, close, gap, tp, max(case when k >= tp then high end) over (partition by symbol, d order by k rows between unbounded preceding and 1 preceding) as peak from h), {_exit('''case when low <= peak - (peak - entry) * 0.3 then 'trailing' end''', 'peak - (peak - entry) * 0.3', 'hp')} select x.symbol, x.d, reason, bar, round(case when z.tp is null then ret else 0.25 + 0.5 * ret end, 5) as ret from x join (select symbol, d, max(tp) as tp from h group by 1, 2) z on z.symbol = x.symbol and z.d = x.d"
    s["k7_hard_floor"] = f"with {_path(10)}, {_exit(f'''case when low <= entry * 0.6 then 'floor' when {trail} then 'trailing' end''', 'case when low <= entry * 0.6 then least(entry * 0.6, open) else peak - (peak - entry) * 0.3 end')} {OUT}"
    s["k10_costs_net"] = f"with {_path(10)}, {_exit('''case when high >= entry * 1.5 then 'tp' end''', 'entry * 1.5')} select x.symbol, d, round(ret, 5) as ret, round(ret - (0.0007::double + 2 * case when rk <= 10 then 0.0002 when rk <= 30 then 0.0005 else 0.001 end::double), 5) as net from x left join {rank} z on z.symbol = x.symbol"
    grid = "gp as (select pk.*, cast(i as int) as config, case i // 2 when 0 then 0.2 when 1 then 0.5 else 1.0 end::double as tp, case i % 2 when 0 then 0.2 else 0.4 end::double as sl from pk, range(6) r(i))"
    ladder = "case when low <= entry * (1 - sl) then 'sl' when high >= entry * (1 + tp) then 'tp' end"
    s["k11_config_sweep"] = f"with {_path(10)}, {grid}, {_exit(ladder, 'case when low <= entry * (1 - sl) then entry * (1 - sl) else entry * (1 + tp) end', 'gp', 'config, symbol, d')} select config, count(*) as n, round(avg(ret), 5) as mean_ret, count(*) filter (reason = 'tp') as tp, count(*) filter (reason = 'sl') as sl, count(*) filter (reason = 'data_gap') as gaps from x group by 1"
    vol = f"(select symbol, d, least(case when count(lr) over {w('19 preceding', 'current row')} >= 2 then stddev_samp(lr) over {w('19 preceding', 'current row')} end, 0.3) as vol from (select symbol, d, ln(close / lag(close) over {W}) as lr from bars))"
    pick = "gp as (select * from (select pk.*, case i // 2 when 0 then 1.0 else 2.0 end::double as mult, case i % 2 when 0 then 3 else 8 end as cap from pk, range(4) r(i)) where k <= cap qualify max(k) over (partition by mult, cap, symbol, d) = cap)"
    s["j10_exit_grid"] = f"with {_path(8, ', a.vol', f'join {vol} a using (symbol, d) where prob >= 0.9 and a.vol > 0').replace('x.a.vol', 'x.vol')}, {pick}, {_exit('''case when low <= entry * (1 - mult * vol) then 'sl' when high >= entry * (1 + mult * vol) then 'tp' end''', 'case when low <= entry * (1 - mult * vol) then entry * (1 - mult * vol) else entry * (1 + mult * vol) end', 'gp', 'mult, cap, symbol, d')} select mult, cap, symbol, d, reason, bar, round(ret, 5) as ret from x"
    return s
