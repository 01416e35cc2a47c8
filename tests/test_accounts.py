"""Covered days, sensitivity, daily balances and guarded figures against plain loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tideline.operators import accounts as AC
from tideline.operators import coverage as CV
from tideline.operators import equity as E
from tideline.operators import reports as R

DAY = dt.date(2024, 1, 1)


def weekdays(a, b):
    return sum((a + dt.timedelta(days=i)).weekday() < 5 for i in range(1, (b - a).days + 1))


def test_weekdays_like_a_loop(spark):
    pairs = [(DAY + dt.timedelta(days=i), DAY + dt.timedelta(days=i + n)) for i in range(8) for n in range(-3, 25)]
    got = spark.createDataFrame(pairs, "a date, b date").select("a", "b", CV.weekdays_after(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == weekdays(r.a, r.b) for r in got)


def plain_covered(counts, today, most=2, prior=30, share=0.5):
    days = sorted(counts)
    last = days[-1]
    before = days[:-1][-prior:]
    need = round(share * sum(counts[d] for d in before) / len(before)) if before else counts[last]
    if weekdays(last, today) > most:
        return None, "stale"
    for d in reversed(days):
        if weekdays(d, last) <= most - 1 and (last - d).days <= most * 2 + 7 and counts[d] >= need:
            return d, "fresh" if d == last else "degraded"
    return None, "uncovered"


def test_covered_day_like_a_loop(spark):
    rng = random.Random(4)
    sources = {f"s{i}": {DAY + dt.timedelta(days=k): rng.choice([1, 3, 9, 10]) for k in range(rng.randrange(1, 50)) if k == 0 or rng.random() < 0.8} for i in range(120)}
    rows = [(s, d) for s, c in sources.items() for d, n in c.items() for _ in range(n)] + [("s0", None), ("none", None)]
    today = DAY + dt.timedelta(days=36)
    rows = [(s, d) for s, d in rows if d is None or d <= today]
    got = {r.s: (r.covered, r.state) for r in CV.covered_day(spark.createDataFrame(rows, "s string, d date"), by="s", day="d", today=F.lit(today)).collect()}
    assert got == {s: plain_covered({d: n for d, n in c.items() if d <= today}, today) for s, c in sources.items()}
    assert {state for _, state in got.values()} == {"stale", "fresh", "degraded", "uncovered"}


def test_sensitivity_rows(spark):
    runs = [("a", 1, 2.0), ("a", 2, 5.0), ("b", 2, 5.0), ("b", 3, None), ("c", 1, 1.0)]
    df = spark.createDataFrame(runs, "rule string, n int, sharpe double")
    got = {(r.axis, r.value): (r.base, r.sharpe) for r in AC.sensitivity(df, ["rule", "n"], "sharpe", ["sharpe"]).collect()}
    # ("a", 2) is best, before ("b", 2) by its axes; ("a", 3) and ("c", 2) were never run
    assert got == {("rule", "a"): (True, 5.0), ("rule", "b"): (False, 5.0), ("rule", "c"): (False, None), ("n", "1"): (False, 2.0), ("n", "2"): (True, 5.0), ("n", "3"): (False, None)}
    assert AC.sensitivity(df.limit(0), ["rule", "n"], "sharpe", ["sharpe"]).count() == 0


def test_balance_like_a_loop(spark):
    rng = random.Random(9)
    at = lambda k: DAY + dt.timedelta(days=k)
    positions = [(rng.choice("xyz"), at(e), None if rng.random() < 0.2 else at(e + rng.randrange(1, 9)), 10.0 + rng.randrange(5), float(rng.randrange(1, 4)), float(rng.randrange(-5, 6))) for e in (rng.randrange(-5, 28) for _ in range(60))]
    marks = [(s, at(k), 8.0 + rng.randrange(9)) for s in "xy" for k in range(-5, 31) if rng.random() < 0.5]
    daily = [(at(k), 100.0 + k) for k in range(-3, 29) if k % 4]
    p = spark.createDataFrame(positions, "symbol string, entry_day date, exit_day date, entry double, qty double, realized double")
    m, d = spark.createDataFrame(marks, "symbol string, d date, price double"), spark.createDataFrame(daily, "d date, equity double")
    for today in (at(30), at(27), at(-1)):
        known = [x for x in daily if x[0] >= DAY and x[0] <= today]
        want, total, last = [], 0.0, None
        own = [x for x in positions if x[1] >= DAY]
        for day, equity in known + ([(today, None)] if today >= DAY and today not in dict(known) else []):
            realized = sum(x[5] for x in own if x[2] == day)
            total += realized
            value = 0.0
            for s, entered, left, entry, qty, _ in own:
                past = [(t, v) for z, t, v in marks if z == s and t <= day]
                if entered <= day and (left is None or left > day) and past:
                    value += (max(past)[1] - entry) * qty
            made = equity is None
            equity = last + realized if made else equity
            want.append((day, made, equity, realized, round(value, 6), None if last is None else equity - last, total))
            last = equity
        x = AC.daily_balance(d.filter(F.col("d") <= F.lit(today)), p, m, since=F.lit(DAY), today=F.lit(today))
        got = x.select("d", "preliminary", "equity", "realized", F.round("unrealized", 6), "delta", "cumulative").collect()
        assert sorted(map(tuple, got)) == want


def test_figures_by_priority_and_guards(spark):
    us = lambda c: f"us-gaap/{c}"
    facts = [
        ("plain", us("SalesRevenueNet"), 5e6, "USD", at, 1) for at in (dt.date(2024, 3, 1),)
    ] + [
        ("plain", us("Revenues"), 4e6, "USD", dt.date(2023, 1, 1), 2), ("plain", us("Revenues"), None, "USD", dt.date(2024, 2, 1), 3), ("plain", us("Revenues"), 9e6, "USD", dt.date(2025, 1, 1), 4),
        ("plain", us("CommonStockSharesIssued"), 2e6, None, dt.date(2023, 5, 1), 5), ("plain", us("EarningsPerShareBasic"), 0.5, "USD/shares", dt.date(2023, 5, 1), 6),
        ("ifrs", "ifrs-full/Revenues", 3e6, "EUR", dt.date(2023, 1, 1), 7), ("ifrs", "ifrs-full/Revenues", 2e6, "USD", dt.date(2022, 1, 1), 8), ("ifrs", us("CommonStockSharesIssued"), 10.0, None, dt.date(2023, 1, 1), 9),
        ("abroad", us("Revenues"), 3e6, "CNY", dt.date(2023, 1, 1), 10), ("abroad", us("CommonStockSharesIssued"), 2e6, None, dt.date(2023, 1, 1), 11),
        ("bank", us("NetInterestIncome"), None, "USD", dt.date(2023, 1, 1), 12), ("bank", us("SalesRevenueNet"), 3e6, "USD", dt.date(2023, 1, 1), 13), ("bank", us("CommonStockSharesIssued"), 2e6, None, dt.date(2023, 1, 1), 14),
    ]
    asof = [(s, dt.date(2024, 6, 1), n, 10.0, 250, 12.0) for s, n in (("plain", None), ("ifrs", "Casualty Bankers"), ("abroad", "x"), ("bank", "x"), ("bare", "Old Bancorp"), (None, "x"))]
    filings = [("abroad", "6-K", dt.date(2024, 1, 1)), ("plain", "20-F", dt.date(2024, 7, 1)), ("bare", "40-F", dt.date(2020, 1, 1))]
    f = spark.createDataFrame(facts, "symbol string, concept string, value double, unit string, day date, id int")
    a = spark.createDataFrame(asof, "symbol string, as_of date, name string, close double, rows int, high_52w double")
    g = spark.createDataFrame(filings, "symbol string, form string, day date")
    x = {r.symbol: r for r in R.guarded_valuation(R.prioritised(a, f, g)).collect()}
    assert (x["plain"].revenue, x["plain"].ps, x["plain"].pe, x["plain"].ps_reason, x["plain"].is_foreign) == (4e6, 5.0, 20.0, None, False)
    assert (x["ifrs"].revenue, x["ifrs"].ps_reason, x["ifrs"].is_insurer, x["ifrs"].is_bank) == (2e6, "valuation_denominator_invalid", True, False)
    assert (x["abroad"].ps, x["abroad"].ps_reason, x["abroad"].currency) == (None, "foreign_currency_not_normalized", "CNY")
    assert (x["bank"].ps, x["bank"].ps_reason, x["bank"].is_bank) == (None, "bank_revenue_concept_missing", True)
    assert (x["bare"].pe_reason, x["bare"].is_bank, x["bare"].revenue) == ("foreign_filer_currency_unknown", True, None)
    assert x[None].revenue is None and len(x) == 6
    assert R.prioritised(a.limit(0), f, g).count() == 0 and R.prioritised(a, f.limit(0), g.limit(0)).count() == 6


def test_causes_are_explained(spark):
    df = spark.createDataFrame([("missing_cik", 1), ("new_cause", 2), (None, 3)], "cause string, i int")
    got = {r.i: (r.group, r.confidence) for r in E.explained(df).collect()}
    assert got == {1: ("data_gap", "high"), 2: ("unknown", "low"), 3: ("unknown", "low")}
