"""SQL for rules, exits and their nulls, insight rules, evidence and gates, written apart from the queries."""

from __future__ import annotations

from .oracle import PREDS, TICKS
from .oracle_equity import J1
from .oracle_intraday import HOURS

P = 20
INST = f"""{HOURS}, mk as (select symbol, cast(epoch(h) / 3600 as bigint) as t, high + 100 as high, low + 100 as low, close + 100 as close, volume from hours),
rt as (select symbol, close / lag(close) over (partition by symbol order by t) - 1 as x from mk), vo as (select symbol, stddev_pop(x) as vol from rt group by 1 having count(x) >= 2),
en as (select mk.*, vol from mk join vo on vo.symbol = mk.symbol where volume > 6 and close < 150),
pa as (select a.symbol, a.t, a.vol, b.t - a.t as k, b.high / a.close as high, b.low / a.close as low, b.close / a.close as close from en a join mk b on b.symbol = a.symbol and b.t > a.t and b.t <= a.t + 8
  where b.t - a.t = (select count(*) from mk z where z.symbol = a.symbol and z.t > a.t and z.t <= b.t))"""
GRID = "grid as (select c * 9 + f * 3 + a as exit, [null, 1.0, 2.0][f + 1]::double as tp, [null, 0.5, 1.0][a + 1]::double as sl, [3, 8][c + 1] as cap from range(2) x(c), range(3) y(f), range(3) z(a))"


def scored(path: str, name: str) -> str:
    return f"""{name}_h as (select exit, symbol, t, vol, cap, tp, sl, k, case when low <= 1 - sl * vol then 'stop' when high >= 1 + tp * vol then 'target' when k = cap then 'time_cap' end as reason, close from {path}, grid where vol > 0 and k <= cap),
{name}_f as (select *, row_number() over (partition by exit, symbol, t order by k) as o from {name}_h where reason is not null),
{name} as (select exit, symbol, t, vol, cast(k as int) as k, reason, case reason when 'stop' then 1 - sl * vol - 1 when 'target' then 1 + tp * vol - 1 else close - 1 end as raw from {name}_f where o = 1)"""


LIFTS = """lf0 as (select symbol, h, ln(1 + max(close) over f) + ln(1 + min(close) over f) - 2 * ln(1 + close) as v from hours window f as (partition by symbol order by h rows between 1 following and 5 following)),
lf as (select concat(symbol, '|', strftime(h, '%Y%m%d%H')) as key, v - avg(v) over (partition by symbol) as v from lf0 where v is not null)"""


def atoms(bins: int) -> str:
    return f"""av as (select feature, list_sort(list(value)) as v from base group by 1 having count(distinct value) > 1), ai as (select feature, v, cast(i as bigint) as i, greatest(1, least(len(v) - 1, i * (len(v) + 1) // {bins})) as j from av, range(1, {bins}) t(i)),
ac as (select distinct feature, round((v[j] * ({bins} - (i * (len(v) + 1) - j * {bins})) + v[j + 1] * (i * (len(v) + 1) - j * {bins})) / {bins}, 12) as cut from ai),
ha as (select concat(symbol, '|', strftime(h, '%Y%m%d%H')) as key, b.feature, concat(b.feature, ' ', op, ' ', printf('%.9f', cut)) as atom from base b join ac on ac.feature = b.feature, (values ('>'), ('<')) o(op) where case op when '>' then value > cut else value < cut end)"""


SHUFFLED = f"""pk as (select key, v, p, row_number() over (partition by p order by md5(concat(key, '|', p))) as o from lf, range(0, {P + 1}) t(p)), sh as (select b.key, b.p, a.v from pk a join pk b on b.o = a.o where a.p = 0 and b.p > 0)"""


def level(hits: str, n: int) -> str:
    """Edges, bar and survivors of the rules that hits (rule, parts, key) hold, once a key."""
    return f"""e{n} as materialized (select rule, count(*) as n, avg(v) as edge from {hits} join lf using (key) group by 1 having count(*) >= 20),
b{n} as materialized (select list_sort(list(m))[cast(round_even(0.95 * {P - 1}, 0) as int) + 1] as bar from (select p, max(m) as m from (select p, rule, avg(sh.v) as m from {hits} join sh using (key) where rule in (select rule from e{n}) group by 1, 2) group by 1)),
k{n} as materialized (select rule, n, edge, bar from e{n}, b{n} where edge > bar)"""


def all_sql() -> dict[str, str]:
    s = {}
    s["j8_permutation_null"] = f"with {J1}, {LIFTS}, {atoms(10)}, {SHUFFLED}, hits as materialized (select atom as rule, key from ha), {level('hits', 1)} select rule, n, round(edge, 6) as edge, round(bar, 6) as null_bar, edge > bar as survives from e1, b1"
    grow = lambda i: f"h{i} as materialized (select distinct list_sort(list_append(h.parts, a.atom)) as parts, array_to_string(list_sort(list_append(h.parts, a.atom)), ' & ') as rule, h.key from h{i - 1} h join k{i - 1} using (rule) join ha a on a.key = h.key where len(list_filter(h.parts, lambda x: starts_with(x, concat(a.feature, ' ')))) = 0)"
    s["j9_depth_search"] = f"with {J1}, {LIFTS}, {atoms(4)}, {SHUFFLED}, h1 as materialized (select [atom] as parts, atom as rule, key from ha join lf using (key)), {level('h1', 1)}, {grow(2)}, {level('h2', 2)}, {grow(3)}, {level('h3', 3)} " + " union all ".join(f"select {i} as depth, rule, n, round(edge, 6) as edge, round(bar, 6) as null_bar from k{i}" for i in (1, 2, 3))
    s["j10_exit_scores"] = f"with {INST}, {GRID}, {scored('pa', 'x')} select exit, symbol, t, k, reason, round(raw, 6) as raw, round(raw / vol, 6) as normed from x"
    s["j11_exit_null"] = f"""with {INST}, {GRID}, {scored('pa', 'x')}, mi as (select symbol, t, vol, k, 2 - low as high, 2 - high as low, 2 - close as close from pa), {scored('mi', 'y')},
        co as (select symbol, t, p, substr(md5(concat(symbol, '|', t, '|', p)), 1, 1) < '8' as heads from (select distinct symbol, t from pa), range(1, {P + 1}) r(p)),
        nu as (select p, exit, avg(v) as m from (select p, exit, raw / vol as v from x join co using (symbol, t) where not heads union all select p, exit, raw / vol from y join co using (symbol, t) where heads) group by 1, 2 having count(*) >= 20),
        be as (select r.p, coalesce(max(m), '-infinity'::double) as m from range(1, {P + 1}) r(p) left join nu on nu.p = r.p group by 1), ba as (select list_sort(list(m))[cast(round_even(0.95 * {P - 1}, 0) as int) + 1] as bar from be),
        re as (select exit, count(*) as n, avg(raw / vol) as edge from x group by 1 having count(*) >= 20 order by edge desc, exit limit 1)
        select exit, n, round(edge, 6) as edge, round(bar, 6) as null_bar, edge > bar as survives from re, ba"""
    s["j14_continuation"] = f"with {INST} select symbol, t, cast(k as int) as k, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close from pa"
    s["j15_trade_log"] = f"with {INST}, {GRID}, {scored('pa', 'x')} select exit as rule, symbol, t as entry_at, t + k as exit_at, reason, round(raw, 6) as raw, round(raw / vol, 6) as normed, case when t % 3 <> 0 then 1 else 2 end as recorded from x where exit in (4, 17)"
    weak = ("", "no_ma_keyword", "pr_wrapper_no_financials", "", "no_financial_metrics", "conference_or_update_boilerplate", "", "no_guidance_language", "debt_issuance_misclassified", "compensation_not_catalyst", "routine_chair_appointment", "", "weak_management_change", "", "routine_board_governance", "", "weak_product_or_project_update", "", "routine_regulatory_disclosure", "")
    found = ", ".join(f"'{x}'" for x in weak)
    s["h6_evidence_sufficiency"] = f"""with q as (select o_orderkey as k, [{found}][o_orderkey % 20 + 1] as weak, coalesce(case when o_orderkey % 3 <> 0 then o_orderkey % 5 <> 0 end, o_orderkey % 2 = 0) as says, o_orderkey % 7 in (0, 6) as flat from orders)
        select k as o_orderkey, case when k % 11 = 0 then 'old' when k % 13 = 0 then 'invalid_quote' when weak <> '' then 'weak_evidence' when says and flat then 'neutral_sentiment' else 'valid' end as status,
        case when k % 11 = 0 or k % 13 = 0 then null when weak <> '' then weak when says and flat then 'neutral_or_mixed_sentiment' else '' end as reason, case when k % 11 = 0 then k % 2 = 0 when k % 13 = 0 or weak <> '' or flat then false else says end as counts from q"""
    s["l8_insight_rules"] = f"""with {PREDS}, cands0 as (select symbol, d, cast(volume as bigint) as num from bars), x as (select c.num, p.ret from cands0 c join preds p on p.symbol = c.symbol and p.d = c.d),
        r as (select 'scorecard_weakness' as category, 'A' as subject, count(*) as n, avg(1 + num % 4) as value, 'high' as severity from x where num % 4 = 0 and num % 3 <> 0 having count(*) >= 3 and avg(1 + num % 4) < 2.5
        union all select 'catalyst_rules', null, count(*), null, 'medium' from x where num % 8 = 1 having count(*) >= 3 union all select 'text_quality', null, count(*), null, 'medium' from x where num % 8 = 2 having count(*) >= 2
        union all select 'feature_gap', null, count(*), null, 'medium' from x where num % 8 = 3 or num % 9 = 0 having count(*) >= 2 union all select 'rejection_rule', null, count(*), avg(ret), 'low' from x where num % 10 = 7 and ret > 0.1 having count(*) >= 3
        union all select 'data_quality', null, count(*), null, 'high' from x where num % 8 = 5 having count(*) >= 2
        union all select 'source_reliability', event_type, count(*) filter (event_id % 5 < length(event_type) % 5), count(*) filter (event_id % 5 < length(event_type) % 5) * 100.0 / count(*), 'high' from events group by event_type having count(*) filter (event_id % 5 < length(event_type) % 5) * 100.0 / count(*) > 30)
        select category, subject, n, round(value, 6) as value, severity from r"""
    # the greedy choice as a recursion over each key's times
    greedy = lambda gap: f"""nx as (select k, ts, (select min(b.ts) from al b where b.k = al.k and b.ts >= al.ts + interval {gap} hour) as nxt from al),
        go as (select k, min(ts) as ts from al group by 1 union all select go.k, nx.nxt from go join nx on nx.k = go.k and nx.ts = go.ts where nx.nxt is not null)"""  # noqa: E731
    s["i15_alert_throttle"] = f"""with recursive {TICKS}, a0 as (select symbol, ts, max(event_id) as id from ticks group by 1, 2),
        a1 as (select symbol, ts, case when id % 40 = 0 then 'page' when id % 40 < 20 then 'warn' else 'info' end as sev, concat('p', (id // 300) % 3) as pay from a0),
        a2 as (select *, case when sev = lag(sev) over (partition by symbol order by ts) and pay = lag(pay) over (partition by symbol order by ts) then 0 else 1 end as new from a1),
        al as (select concat(symbol, '|', sev, '|', pay, '|', sum(new) over (partition by symbol order by ts)) as k, ts from a2), {greedy(6)}
        select split_part(k, '|', 1) as symbol, split_part(k, '|', 2) as severity, split_part(k, '|', 3) as payload, epoch_us(ts) as at from go"""
    s["i16_cooldown_gate"] = f"""with recursive {HOURS}, held as (select symbol, 'buy' as side, h as a, h + interval 150 minute as b from hours where hour(h) % 6 = 0 union all select symbol, 'sell', h, h + interval 90 minute from hours where hour(h) % 8 = 3),
        sg as (select distinct symbol, case when maker then 'sell' else 'buy' end as side, ts from ticks),
        al as (select concat(symbol, '|', side) as k, ts from sg where not exists (select 1 from held where held.symbol = sg.symbol and held.side = sg.side and a <= ts and b > ts)), {greedy(4)}
        select split_part(k, '|', 1) as symbol, split_part(k, '|', 2) as side, epoch_us(ts) as at from go"""
    s["a15_tape_stream"] = f"with {TICKS} select symbol, epoch_us(ts) as at, event_id, round(price * qty, 6) as notional from ticks"
    return s
