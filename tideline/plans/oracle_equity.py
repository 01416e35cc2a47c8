"""SQL for company features, outcomes, causes and discovery atoms, written apart from the queries."""

from __future__ import annotations

from .oracle import BARS, FILINGS, LAG, PREDS, TICKS, W, w
from .oracle_intraday import HOURS, QUOTES
from .oracle_paths import CANDS

FACTS = """facts as (select concat('S', cast(o_custkey % 10 as varchar)) as symbol, case o_orderstatus when 'F' then 'income' when 'O' then 'revenue' else 'shares' end as concept, case o_orderstatus when 'F' then o_totalprice - 120000 when 'O' then o_totalprice * 3 else o_totalprice * 20 end as value, cast(o_orderdate as date) as day, o_orderkey as id from orders),
pairs as (select *, lag(value) over (partition by symbol, concept order by day, id) as before from facts),
lastf as (select symbol, concept, day, arg_max(value, id) as value, max_by(struct_pack(b := before), id).b as before from pairs group by 1, 2, 3)"""
MONTHS = "months as (select distinct symbol, last_day(d) as as_of from bars)"


def _fact(c: str) -> str:
    return f"{c} as (select m.symbol, m.as_of, f.value as {c}, f.before as {c}_before, f.day as {c}_at from months m asof left join (select * from lastf where concept = '{c}') f on f.symbol = m.symbol and f.day <= m.as_of)"


REPORTED = f"{BARS}, {FACTS}, {MONTHS}, {_fact('income')}, {_fact('revenue')}, {_fact('shares')}, rep as (select * from income join revenue using (symbol, as_of) join shares using (symbol, as_of))"
QUALITY = "q1 as (select *, case when revenue_before <> 0 then (revenue - revenue_before) / abs(revenue_before) * 100 end as g0, case when revenue <> 0 and not (income > 0 and revenue > 0 and income > revenue) then income / revenue * 100 end as margin, case when shares_before > 0 then (shares - shares_before) / shares_before * 100 end as dilution, date_diff('day', greatest(income_at, revenue_at, shares_at), as_of) as age from {src}), q2 as (select *, case when abs(g0) <= 500 then g0 end as growth from q1), qual as (select *, case when growth > 20 then 90.0 when growth > 10 then 75.0 when growth >= 0 then 60.0 when growth is not null then 30.0 end as growth_score, case when margin > 20 then 90.0 when margin > 10 then 75.0 when margin > 0 then 55.0 when margin is not null then 20.0 end as margin_score, case when dilution < 2 then 85.0 when dilution < 5 then 65.0 when dilution is not null then 30.0 end as dilution_score, case when income > 0 then 70.0 when income is not null then 30.0 end as income_score from q2)"
VALUED = f"""{REPORTED}, pb0 as (select *, count(*) over {w('unbounded preceding', 'current row')} as n_rows, max(high) over (partition by symbol order by d range between interval 364 day preceding and current row) as high_52w from bars),
priced as (select symbol, last_day(d) as as_of, arg_max(close, d) as close, arg_max(n_rows, d) as n_rows, arg_max(high_52w, d) as high_52w from pb0 group by 1, 2),
v0 as (select r.symbol, r.as_of, income, income_at, revenue_at, shares_at, shares, shares_before, revenue * 4000 as revenue, revenue_before, revenue_before * 4000 as equity, income / 2000 as eps, close, n_rows, high_52w from rep r join priced p using (symbol, as_of)),
v1 as (select *, case when n_rows >= 20 and high_52w > 0 then close / high_52w * 100 end as vs_high, case when revenue > 0 and shares >= 1000000 then close * shares / revenue end as ps0, case when eps > 0 then close / eps end as pe0, case when equity > 0 and shares >= 1000000 then close / (equity / shares) end as pb0 from v0),
v2 as (select *, case when ps0 between 0.05 and 100 then ps0 end as ps, case when pe0 between 0 and 150 then pe0 end as pe, case when pb0 between 0 and 50 then pb0 end as pb from v1),
valued as (select *, greatest(0.0, least(100.0, 100 - vs_high)) as hs, case when ps < 1 then 90.0 when ps < 3 then 70.0 when ps < 10 then 50.0 when ps is not null then 20.0 end as ps_score, case when pe < 10 then 90.0 when pe < 20 then 75.0 when pe < 30 then 55.0 when pe < 50 then 35.0 when pe is not null then 15.0 end as pe_score, case when pb < 1 then 80.0 when pb < 2 then 65.0 when pb < 5 then 45.0 when pb is not null then 20.0 end as pb_score from v2)"""
MOVES = f"rets as (select *, {LAG(1)} as ret_1, {LAG(5)} as ret_5 from bars), moves as (select * from rets where abs(ret_1) > 0.2)"
J1 = f"""{HOURS}, {QUOTES.split('), ', 1)[1] if QUOTES.startswith('ticks as') else QUOTES}, qh as (select symbol, date_trunc('hour', ts) as h, avg(ask - bid) as spread, arg_max(bid, (ts, event_id)) as bid, arg_max(ask, (ts, event_id)) as ask, avg(bid_qty) as bq, avg(ask_qty) as aq from quotes group by 1, 2),
jx as (select h.*, q.* exclude (symbol, h) from hours h join qh q on q.symbol = h.symbol and q.h = h.h),
long as ({' union all '.join(f"select symbol, h, '{n}' as feature, cast({e} as double) as value from jx" for n, e in (('total_vol', 'volume'), ('taker_buy_ratio', 'taker_buy / nullif(volume, 0)'), ('trade_count', 'trades'), ('price_range', '(high - low) / nullif(open, 0)'), ('ret_co', '(close - open) / nullif(open, 0)'), ('rel_spread', 'spread / nullif((bid + ask) / 2, 0)'), ('book_imbalance', 'bq / nullif(bq + aq, 0)')))}),
base as (select symbol, h, feature, round(value, 7) as value from long where value is not null)"""


CONCEPTS = {
    "revenue": "us-gaap/Revenues us-gaap/RevenueFromContractWithCustomerExcludingAssessedTax us-gaap/SalesRevenueNet",
    "world": "ifrs-full/Revenues",
    "shares": "us-gaap/WeightedAverageNumberOfDilutedSharesOutstanding us-gaap/CommonStockSharesOutstanding us-gaap/CommonStockSharesIssued",
    "eps": "us-gaap/EarningsPerShareDiluted us-gaap/EarningsPerShareBasic",
    "world_eps": "ifrs-full/EarningsPerShareDiluted",
    "equity": "us-gaap/StockholdersEquity us-gaap/LiabilitiesAndStockholdersEquity",
    "industry": "us-gaap/NetInterestIncome us-gaap/PremiumsEarnedNet",
}
ORDERED = [c for g in ("revenue", "world", "shares", "eps", "world_eps", "equity", "industry") for c in CONCEPTS[g].split()]


def _chosen(group: str) -> str:
    names = CONCEPTS[group].split()
    usd = " and (unit = 'USD' or unit like 'USD/%')" if group.startswith("world") else ""
    return f"arg_min(value, (list_position({names}, concept), date_diff('day', day, date '2100-01-01'), -id)) filter (value is not null and concept in {tuple(names + [""])}{usd}) as {group}"


STATEMENTS = f"""st0 as (select concat('C', o_custkey) as symbol, {ORDERED}[o_orderkey % {len(ORDERED)} + 1] as concept, o_orderkey as id, cast(o_orderdate as date) as day,
        cast(o_totalprice as double) as price, case when o_orderkey % 9 = 0 then 'EUR' when o_orderkey % 7 <> 0 then 'USD' end as unit from orders),
st as (select symbol, concept, id, day, case when concept like '%PerShare%' then unit || '/shares' else unit end as unit, case when id % 13 <> 0 then
        case when concept like '%PerShare%' then (price - 100000) / 10000 when concept like '%Equity%' then (price - 80000) * 500 when concept like '%Shares%' then price * 20 else price * 1000 end end as value from st0),
cd as (select distinct symbol, last_day(day) as as_of, cast(substr(symbol, 2) as int) as n from st),
ff as (select concat('C', o_custkey) as symbol, min(cast(o_orderdate as date)) as since from orders where o_orderkey % 31 = 0 group by 1),
pr as (select cd.symbol, cd.as_of, n, coalesce(since <= as_of, false) as is_foreign, {', '.join(_chosen(g) for g in CONCEPTS if g != 'industry')},
        arg_max(unit, (day, id)) filter (concept in {tuple(CONCEPTS['revenue'].split())} and value is not null and unit is not null) as currency,
        count(*) filter (concept = 'us-gaap/NetInterestIncome') as banks, count(*) filter (concept = 'us-gaap/PremiumsEarnedNet') as insurers,
        count(*) filter (concept = 'us-gaap/Revenues' and value is not null) as totals
    from cd join st on st.symbol = cd.symbol and st.day <= cd.as_of left join ff on ff.symbol = cd.symbol group by 1, 2, 3, 4),
gv as (select *, 3.0::double + n % 97 as price, case when revenue <> 0 then revenue else world end as rev, coalesce(eps, world_eps) as e,
        insurers > 0 or (banks = 0 and n % 9 <> 0 and (n % 10 = 0 or n % 11 = 0)) as is_insurer,
        insurers = 0 and (banks > 0 or n % 9 = 0) as is_bank,
        case when is_foreign and currency is null then 'foreign_filer_currency_unknown' when is_foreign and currency <> 'USD' then 'foreign_currency_not_normalized' end as abroad from pr),
gr as (select *, case when rev > 0 and shares >= 1000000 then price * shares / rev end as s0, case when e > 0 then price / e end as e0, case when equity > 0 and shares >= 1000000 then price / (equity / shares) end as b0 from gv),
gx as (select *, coalesce(abroad, case when is_bank and totals = 0 then 'bank_revenue_concept_missing' when s0 not between 0.05 and 100 or shares < 1000000 then 'valuation_denominator_invalid' end) as ps_reason,
        coalesce(abroad, case when e0 not between 0 and 150 then 'valuation_denominator_invalid' end) as pe_reason,
        coalesce(abroad, case when b0 not between 0 and 50 or shares < 1000000 then 'valuation_denominator_invalid' end) as pb_reason from gr),
gw as (select *, case when ps_reason is null then s0 end as ps, case when pe_reason is null then e0 end as pe, case when pb_reason is null then b0 end as pb from gx)"""


def all_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["a6_snapshot_read"] = "select event_id, user_id, cast(floor(epoch(ts)) as bigint) as at from events where ts >= timestamp '2024-01-08 00:00:00' and event_type <> 'view'"
    s["a1_tape_scan"] = f"with {TICKS} select event_id, symbol, round(price, 6) as price from ticks where symbol in ('U1', 'U2', 'U7') and ts > timestamp '2024-01-05 12:00:00' and ts <= timestamp '2024-01-20 00:00:00'"
    s["a5_partitioned_sink"] = f"with {TICKS} select symbol, cast(ts as date) as date, count(*) as n, cast(sum(event_id) as bigint) as ids from ticks group by 1, 2"
    s["a10_compact_partitions"] = f"with {TICKS} select symbol, cast(ts as date) as date, count(*) as rows_in, count(*) as rows_out, true as same from ticks group by 1, 2"
    s["a14_report_export"] = f"with {BARS} select symbol, cast(d as varchar) as d, trades, cast(null as varchar) as note from bars"
    s["b10_incomplete_subcause"] = """with q as (select s_suppkey as k, date_diff('day', date '2001-08-02' - cast(s_suppkey * 7 % 230 as int), date '2001-08-02') as age, s_suppkey % 4 <> 0 as filed, s_acctbal > 2000 as capped, ['Energy', 'Financials', 'Health', 'Utilities', 'Tech', 'Tech', 'Real Estate'][s_suppkey % 7 + 1] as sector, s_nationkey from supplier)
        select k as s_suppkey, case when k % 11 = 0 then 'missing_cik' when k % 3 <> 0 and k % 5 = 0 then 'missing_sec_companyfacts' when s_nationkey % 6 = 0 then 'foreign_filer_or_adr' when filed and age > 180 then 'stale_fundamentals' when not filed and not capped then 'recent_ipo_or_short_history' when sector in ('Financials', 'Real Estate', 'Utilities') then 'sector_specific_model_gap' when filed and not capped then 'polygon_fundamentals_missing' when k % 3 <> 0 and k % 5 <> 0 and filed then 'ifrs_mapping_gap' else 'price_only_scored' end as subcause from q"""
    s["b11_root_cause"] = f"""with {CANDS}, {FILINGS}, {MOVES}, x as (select c.*, exists (select 1 from filings f where f.symbol = c.symbol and f.form = '10-Q' and f.filing_date between c.d - 2 and c.d + 2) as due,
        (select count(*) from moves o where o.symbol <> c.symbol and cast(substr(o.symbol, 2) as int) % 3 = cast(substr(c.symbol, 2) as int) % 3 and o.d between c.d - 1 and c.d + 1) >= 3 as grouped from cands c join moves m on m.symbol = c.symbol and m.d = c.d)
        , causes as (select symbol, d, case when num % 17 = 0 then 'universe_not_seeded' when num % 13 = 0 then 'pre_score_history' when num % 6 = 0 then case when num % 4 = 0 then 'missing_cik' else 'price_only_scored' end when due then 'missing_earnings_context' when grouped then 'sector_cluster_move' when num % 7 = 0 then 'no_evidence_no_filing' when num % 5 = 0 and catalyst < 30 then 'near_threshold_no_catalyst' when num % 5 = 0 then 'near_threshold_scored' when catalyst < 30 then 'low_catalyst_score' when quality < 40 then 'low_quality_score' else 'unknown' end as cause from x)
        select symbol, d, cause, case cause when 'universe_not_seeded' then 'universe_gap' when 'sector_specific_model_gap' then 'scoring_gap' when 'low_catalyst_score' then 'scoring_gap' when 'low_quality_score' then 'scoring_gap'
                when 'missing_earnings_context' then 'feature_gap' when 'sector_cluster_move' then 'feature_gap' when 'near_threshold_no_catalyst' then 'near_miss' when 'near_threshold_scored' then 'near_miss' when 'unknown' then 'unknown' else 'data_gap' end as "group",
            case when cause in ('universe_not_seeded', 'pre_score_history', 'missing_cik') then 'high' when cause in ('price_only_scored', 'low_quality_score', 'unknown') then 'low' else 'medium' end as confidence,
            case cause when 'universe_not_seeded' then 'was_in_universe,classification' when 'pre_score_history' then 'classification,score_join_method' when 'missing_cik' then 'tier_before_event,companies.cik' when 'price_only_scored' then 'tier_before_event'
                when 'missing_earnings_context' then 'event_date,events.event_date,events.event_type' when 'sector_cluster_move' then 'companies.sector,window_days,event_date' when 'no_evidence_no_filing' then 'had_catalyst_evidence'
                when 'low_catalyst_score' then 'scores.catalyst_score' when 'low_quality_score' then 'scores.quality_score' when 'unknown' then '' else 'score_before_event,scores.catalyst_score' end as fields
        from causes"""
    s["b22_lifecycle"] = f"""with {BARS}, {MOVES}, l as (select symbol, arg_max(close, d) as latest, max(d) as latest_day from bars group by 1),
        g as (select symbol, d, close, lead(d, 4) over {W} as until, lead(close, 4) over {W} / close - 1 as gain from bars),
        q as (select m.symbol, m.d, m.close, l.latest, l.latest_day,
            (select max(b.close) from bars b where b.symbol = m.symbol and b.d >= m.d) as hi,
            (select min(b.close) from bars b where b.symbol = m.symbol and b.d >= m.d) as lo,
            (select min(g.d) from g where g.symbol = m.symbol and g.gain >= 0.05 and g.close > 0 and g.d >= m.d - 27 and g.until < m.d) as start
            from moves m join l on l.symbol = m.symbol),
        p as (select q.symbol, q.d, coalesce(q.start, q.d) as episode_start, latest < q.close as below, latest / q.close - 1 as since, latest / coalesce(b.close, q.close) - 1 as since_episode, hi / q.close - 1 as runup,
            lo / q.close - 1 as drawdown, latest / hi - 1 as from_peak, cast(date_diff('day', q.d, latest_day) as int) as elapsed from q left join bars b on b.symbol = q.symbol and b.d = q.start),
        o as (select *, case when since is null then 'insufficient_data'
            when runup >= 0.1 and since < runup / 2 then 'validated_then_faded'
            when since >= 0.1 then 'validated' when since <= -0.05 then 'failed' when elapsed > 126 then 'expired' when abs(since) < 0.03 then 'inconclusive' else 'pending' end as outcome,
            case when since is null then 'insufficient_data'
            when below then case when runup > 0.02 and since > drawdown then 'recovery_attempt' else 'post_event_fade' end
            when elapsed <= 5 then 'initial_event_reaction'
            when elapsed > 126 then case when since > 0 then 'extended_move' else 'post_event_fade' end
            when elapsed > 20 then case when since > 0 then 'continuation' else 'post_event_fade' end
            when abs(since) < 0.03 then 'no_price_confirmation' else 'continuation' end as phase from p)
        select symbol, d, episode_start, round(since, 6) as since, round(since_episode, 6) as since_episode, round(runup, 6) as runup, round(drawdown, 6) as drawdown, round(from_peak, 6) as from_peak, elapsed, outcome, phase,
            case outcome when 'insufficient_data' then 'insufficient_data' when 'validated' then 'context' when 'validated_then_faded' then 'investigate' when 'failed' then 'avoid' when 'expired' then 'expired'
            else case phase when 'initial_event_reaction' then 'high_priority' when 'post_event_fade' then 'investigate' else 'watch' end end as action from o"""
    s["c21_theme_join"] = f"""with {BARS}, {MOVES}, t as (select symbol, concat('odd', cast(substr(symbol, 2) as int) % 2) as theme from (select distinct symbol from bars) union all select symbol, concat('third', cast(substr(symbol, 2) as int) % 3) from (select distinct symbol from bars))
        select m.symbol, m.d, a.theme, count(*) as peers, round(median(p.ret_5), 6) as median, round(avg(p.ret_5), 6) as mean from moves m join t a on a.symbol = m.symbol join t b on b.theme = a.theme and b.symbol <> a.symbol join rets p on p.symbol = b.symbol and p.d = m.d where p.ret_5 is not null group by 1, 2, 3"""
    s["d41_net_pnl"] = f"""with {PREDS}, {FILINGS}, p as (select symbol, d, close as entry, close * peak as mark, cast(1 + year(d) % 3 as double) as qty from preds where prob >= 0.8 and peak is not null), u as (select symbol, cast(max(filing_date) - 300 as date) as until from filings where form = '10-K' group by 1),
        q as (select p.*, u.until >= p.d + 5 as done, coalesce((select sum(accession % 7 - 3) from filings f where f.symbol = p.symbol and f.filing_date >= p.d and f.filing_date < p.d + 5), 0) as funding from p left join u on u.symbol = p.symbol)
        select symbol, d, round((mark - entry) * qty + 1e-7, 4) as gross, round(case when done then (mark - entry) * qty + funding - (entry + mark) * qty * 0.001 + 1e-7 end, 4) as net, case when done then 'reconciled' else 'pending' end as state from q"""
    points = ", ".join(f"round((select arg_min(x.close, x.d) from bars x where x.symbol = b.symbol and x.d >= b.d + {k}) / b.close - 1, 6) as ret_{k}d" for k in (1, 3, 5, 10, 20, 60, 120))
    s["e19_forward_outcomes"] = f"""with {BARS}, n as (select symbol, d, close, row_number() over {W} as k from bars),
        hit as (select a.symbol, a.d, count(*) filter (z.close / a.close - 1 >= 0.1) as up_10, count(*) filter (z.close / a.close - 1 >= 0.2) as up_20, count(*) filter (z.close / a.close - 1 <= -0.1) as down
            from n a join n z on z.symbol = a.symbol and z.k > a.k and z.k <= a.k + 20 group by 1, 2),
        f as (select symbol, d, {', '.join(f"round({g}(close) over {w('1 following', f'{k} following')} / close - 1, 6) as {m}_{k}" for g, m in (('max', 'runup'), ('min', 'drawdown')) for k in (20, 60))} from bars)
        select b.symbol, b.d, {points}, f.* exclude (symbol, d), up_10 > 0 and down = 0 as hit_10, up_20 > 0 and down = 0 as hit_20
        from bars b join f on f.symbol = b.symbol and f.d = b.d left join hit on hit.symbol = b.symbol and hit.d = b.d"""
    s["e21_running_equity"] = f"with {PREDS}, q as (select model, d, sum(ret) as step from preds where ret is not null group by 1, 2) select model, d, round(step, 6) as step, round(sum(step) over (partition by model order by d), 6) as total from q"
    s["e23_quality_features"] = f"with {REPORTED}, {QUALITY.format(src='rep')} select symbol, as_of, round(income, 4) as income, round(growth, 4) as growth, round(margin, 4) as margin, round(dilution, 4) as dilution, income_score, growth_score, margin_score, dilution_score, cast(age as int) as age, case when age > 180 then 'low' else 'medium' end as confidence from qual"
    s["e23_industry_guard"] = f"""with {REPORTED}, {QUALITY.format(src='rep')}, z as (select *, cast(substr(symbol, 2) as int) % 3 = 0 as bank, cast(substr(symbol, 2) as int) % 4 = 1 as insurer from qual)
        select symbol, as_of, round(growth, 4) as growth, round(margin, 4) as margin, case when growth is null or bank then 'low' else 'medium' end as growth_confidence,
            case when margin is null or bank or insurer then 'low' else 'medium' end as margin_confidence,
            case when margin is null then null when bank then 'bank_specific_quality_required' when insurer then 'insurance_specific_quality_required' end as margin_warning from z"""
    s["e24_guarded_valuation"] = f"""with {STATEMENTS} select symbol, as_of, round(ps, 4) as ps, round(pe, 4) as pe, round(pb, 4) as pb,
        case when ps < 1 then 90.0 when ps < 3 then 70.0 when ps < 10 then 50.0 when ps is not null then 20.0 end as ps_score,
        case when pe < 10 then 90.0 when pe < 20 then 75.0 when pe < 30 then 55.0 when pe < 50 then 35.0 when pe is not null then 15.0 end as pe_score,
        case when pb < 1 then 80.0 when pb < 2 then 65.0 when pb < 5 then 45.0 when pb is not null then 20.0 end as pb_score,
        ps_reason, pe_reason, pb_reason, is_bank, is_insurer, is_foreign, case when currency = 'USD' or currency = 'EUR' then currency end as currency from gw"""
    s["e24_valuation_features"] = f"with {VALUED} select symbol, as_of, round(vs_high, 4) as vs_high, round(ps, 4) as ps, round(pe, 4) as pe, round(pb, 4) as pb, round(case when vs_high is not null then hs end, 4) as high_score, ps_score, pe_score, pb_score from valued"
    s["e25_momentum_features"] = f"""with {BARS}, n as (select *, row_number() over {W} as k, first_value(close) over {W} as f, lag(close, 20) over {W} as c20, lag(close, 60) over {W} as c60, avg(volume) over {w('20 preceding', '1 preceding')} as av, max(close) over {w('19 preceding', 'current row')} as hi from bars),
        q as (select symbol, d, case when k >= 20 then close / coalesce(c20, f) * 100 - 100 end as a, case when k >= 20 then close / coalesce(c60, f) * 100 - 100 end as b, case when k >= 20 then volume / nullif(av, 0) end as s, case when k >= 20 then close / hi * 100 - 100 end as g from n)
        select symbol, d, round(a, 5) as ret_20, round(b, 5) as ret_60, round(s, 5) as spike, round(g, 5) as drawdown, round(case when s is not null then greatest(0.0, least(90.0, 50 + (s - 1) * 20)) end, 5) as spike_score, round(case when g is not null then least(100.0, greatest(0.0, 50 + g * 2)) end, 5) as drawdown_score,
        case when a > 15 then 80.0 when a > 5 then 65.0 when a >= -5 then 50.0 when a is not null then 25.0 end as score_20, case when b > 25 then 80.0 when b > 10 then 65.0 when b >= -10 then 50.0 when b is not null then 25.0 end as score_60 from q"""
    miss = " + ".join(f"(case when {c} is null then 1 else 0 end)" for c in ("vs_high", "ps_score", "pe_score", "pb_score", "growth_score", "margin_score", "dilution_score", "income_score"))
    s["e26_risk_features"] = f"with {VALUED}, {FILINGS}, {QUALITY.format(src='valued')}, z as (select q.*, ({miss}) / 8.0 as missing, exists (select 1 from filings f where f.symbol = q.symbol and f.form = '8-K' and last_day(f.filing_date) = q.as_of) as filed from qual q) select symbol, as_of, least(100.0, (case when missing > 0.7 then 35.0 when missing > 0.4 then 15.0 else 0 end) + (case when income <= 0 then 20.0 else 0 end) + (case when close / 700 < 2 then 20.0 else 0 end) + (case when n_rows < 20 then 10.0 else 0 end) + (case when filed then 0 else 15.0 end))::double as penalty from z"
    s["e27_catalyst_features"] = f"""with {BARS}, {FILINGS}, {MONTHS}, v as (select symbol, last_day(d) as as_of, sum(volume) as i from bars group by 1, 2), c as (select symbol, as_of, lag(i) over (partition by symbol order by as_of) as old, i from v),
        q as (select m.symbol, m.as_of, count(*) filter (form = '8-K' and filing_date between m.as_of - 30 and m.as_of) as n_8k, max(accession % 3 <> 0) filter (form = '8-K' and filing_date between m.as_of - 30 and m.as_of) as routine, count(*) filter (form in ('10-Q', '10-K') and filing_date between m.as_of - 45 and m.as_of) as n_reports, count(*) filter (form = '10-Q' and filing_date > m.as_of and filing_date <= m.as_of + 14) as n_due from months m left join filings f on f.symbol = m.symbol and f.filing_date between m.as_of - 45 and m.as_of + 14 group by 1, 2),
        z as (select q.*, case when old > 0 then (i - old) / old * 100 end as ch from q join c using (symbol, as_of)),
        y as (select *, case when n_8k > 0 and not routine then 30.0 when n_8k > 0 then 15.0 end as a, case when n_reports > 0 then 5.0 end as b, case when n_due > 0 then 25.0 end as e, case when abs(ch) > 10 then 15.0 end as g from z)
        select symbol, as_of, n_8k, n_reports, n_due, round(ch, 5) as si_change, least(100.0, coalesce(a, 0) + coalesce(b, 0) + coalesce(e, 0) + coalesce(g, 0))::double as score, cast((a is not null)::int + (b is not null)::int + (e is not null)::int + (g is not null)::int as int) as signals from y"""
    kinds = (("merger_acquisition", "bullish", "merger_agreement"), ("merger_acquisition", "bullish", "acquisition"), ("earnings", "neutral", "earnings_release"), ("earnings", "mixed", "earnings_surprise"), ("guidance", "bullish", "guidance_raised"), ("guidance", "bearish", "guidance_lowered"), ("management_change", "neutral", "exec_appointment"), ("management_change", "bearish", "exec_departure"), ("regulatory", "bearish", "legal_settlement"), ("regulatory", "bullish", "clinical_trial_positive"), ("regulatory", "bullish", "fda_approval"), ("regulatory", "bearish", "fda_rejection"), ("product_launch", "bullish", "product_launch"), ("product_launch", "bullish", "buyback_program"))
    lists = [", ".join(f"'{k[i]}'" for k in kinds) for i in range(3)]
    s["h5_catalyst_rules"] = f"select o_orderkey, [{lists[0]}][o_orderkey % 15 + 1] as type, [{lists[1]}][o_orderkey % 15 + 1] as sentiment, [{lists[2]}][o_orderkey % 15 + 1] as rule from orders"
    s["h12_math"] = f"with {TICKS} select event_id, round(ln(price + 1), 9) as ln, round(log10(price + 1), 9) as log10, round(sqrt(price), 9) as root, abs(price - 50) as off, greatest(price, 20.0) as top, least(price, 80.0) as low, cast(floor(price) as bigint) as whole, round(sin(price), 9) as sine, round(cos(price), 9) as cosine, greatest(10.0, least(90.0, price)) as held from ticks"
    s["j1_base_features"] = f"with {J1} select symbol, h, feature, value from base"
    s["j4_quantile_atoms"] = f"""with {J1}, v as (select feature, list_sort(list(value)) as v from base group by 1 having count(distinct value) > 1), i as (select feature, v, cast(i as bigint) as i, greatest(1, least(len(v) - 1, i * (len(v) + 1) // 10)) as j from v, range(1, 10) t(i)),
        c as (select distinct feature, round((v[j] * (10 - (i * (len(v) + 1) - j * 10)) + v[j + 1] * (i * (len(v) + 1) - j * 10)) / 10, 12) as cut from i) select feature, op, round(cut, 9) as cut from c, (values ('>'), ('<')) o(op)"""
    s["k9_entry_rules"] = f"with {HOURS} select a.symbol, a.h as signal, b.h as entry_at, round(b.open, 6) as open from hours a join hours b on b.symbol = a.symbol and b.h = a.h + interval 26 hour where a.close > 90"
    s["l9_investigation_flags"] = f"""with {CANDS}, {FILINGS}, {MOVES}, o as (select concat('S', cast(o_custkey % 10 as varchar)) as symbol, min(cast(o_orderdate as date)) + 400 as since from orders group by 1),
        x as (select c.symbol, c.d, c.num, coalesce(c.catalyst < 50, false) as low, coalesce(o.since <= c.d, false) as facts, exists (select 1 from filings f where f.symbol = c.symbol and f.form = '8-K' and f.filing_date between c.d - 2 and c.d) as filed, exists (select 1 from filings f where f.symbol = c.symbol and f.form = '8-K' and f.accession % 3 = 0 and f.filing_date between c.d - 2 and c.d) as mat from cands c join moves m on m.symbol = c.symbol and m.d = c.d left join o on o.symbol = c.symbol),
        y as (select *, not (filed and low) and num % 2 <> 0 and not filed as quiet from x),
        z as (select symbol, d, filed and low and mat as text_needed, list_filter([case when num % 17 = 0 then 'not_in_universe' end, case when num % 19 = 0 then 'missing_price_data' end, case when not facts then 'missing_fundamentals' end, case when num % 5 = 0 then 'threshold_too_strict' end, case when filed and low and mat then 'text_evidence_available_not_classified' end, case when filed and low and mat then 'needs_llm_text_enrichment' end, case when filed and low and not mat then 'routine_event_correctly_suppressed' end, case when quiet and num % 3 <> 0 then 'no_public_catalyst_source_found' end, case when quiet and num % 3 = 0 then 'price_move_without_known_catalyst' end], lambda v: v is not null) as l from y)
        select symbol, d, case when len(l) > 0 then array_to_string(l, ',') else 'truly_unpredictable' end as labels, case when len(l) > 0 then l[1] else 'truly_unpredictable' end as primary_label, text_needed from z"""
    return s
