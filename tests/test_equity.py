"""Company features and atoms against plain loops."""

import random
import statistics
from datetime import date, timedelta

from pyspark.sql import functions as F

from tideline.operators import equity as E


def test_atoms_are_exclusive_quantiles(spark):
    rng = random.Random(4)
    values = {"a": [rng.randrange(40) / 4 for _ in range(137)], "b": [1.0] * 30, "c": [float(i) for i in range(3)], "d": [2.0] * 50 + [3.0]}
    rows = [(f, v) for f, vs in values.items() for v in vs] + [("a", None)]
    got = {(x.feature, x.op, x.cut) for x in E.quantile_atoms(spark.createDataFrame(rows, "feature string, value double")).collect()}
    want = {(f, op, round(c, 12)) for f, vs in values.items() if len(set(vs)) > 1 for c in statistics.quantiles(vs, n=10, method="exclusive") for op in "<>"}
    assert got == want


def test_catalyst_rules_take_the_first(spark):
    said = ["definitive merger agreement, to be acquired by X", "TO BE ACQUIRED BY Y", "nothing", "", None, "cut its outlook"]
    got = [x.c and x.c.rule for x in spark.createDataFrame([(t,) for t in said], "t string").select(E.catalyst_rule(F.col("t")).alias("c")).collect()]
    assert got == ["merger_agreement", "acquisition", None, None, None, "guidance_lowered"]


def test_forward_outcomes(spark):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in (0, 1, 4, 5, 9)]
    close = [100.0, 95.0, 112.0, 80.0, 130.0]
    bars = spark.createDataFrame([("A", d, c) for d, c in zip(days, close, strict=True)], "symbol string, d date, close double")
    got = {x.d: x for x in E.forward_outcomes(bars, bars).collect()}
    x = got[days[0]]
    assert round(x.ret_1d, 9) == -0.05 and round(x.ret_3d, 9) == 0.12 and round(x.ret_10d or 0, 9) == 0 and x.ret_10d is None
    assert (x.hit_10, x.hit_20) == (False, False) and round(x.runup_20, 9) == 0.3 and round(x.drawdown_20, 9) == -0.2
    assert got[days[3]].hit_10 is True and got[days[2]].hit_10 is False and got[days[4]].hit_10 is None


def test_last_two_facts(spark):
    facts = spark.createDataFrame([("A", "income", 5.0, date(2024, 1, 1), 1), ("A", "income", 7.0, date(2024, 1, 1), 2), ("A", "income", 9.0, date(2024, 3, 1), 3)], "symbol string, concept string, value double, as_of_date date, fact_id int")
    asof = spark.createDataFrame([("A", date(2023, 12, 31)), ("A", date(2024, 2, 1)), ("A", date(2024, 3, 1)), ("B", date(2024, 3, 1))], "symbol string, as_of date")
    got = {(x.symbol, x.as_of): (x.income, x.income_before) for x in E.last_two(asof, facts, ["income"]).collect()}
    assert got == {("A", date(2023, 12, 31)): (None, None), ("A", date(2024, 2, 1)): (7.0, 5.0), ("A", date(2024, 3, 1)): (9.0, 7.0), ("B", date(2024, 3, 1)): (None, None)}


def test_lifecycle_ladder(spark):
    """One symbol a case: days since the event, closes from the event on; then what follows from them."""
    import datetime as dt

    cases = {
        "A": ([(0, 100), (30, 115)], "validated", "continuation", "context"),
        "B": ([(0, 100), (200, 108)], "expired", "extended_move", "expired"),
        "C": ([(0, 100), (10, 101)], "inconclusive", "no_price_confirmation", "watch"),
        "D": ([(0, 100), (10, 105)], "pending", "continuation", "watch"),
        "E": ([(0, 100), (3, 105)], "pending", "initial_event_reaction", "high_priority"),
        "F": ([(0, 100), (5, 95)], "failed", "post_event_fade", "avoid"),
        "G": ([(0, 100), (5, 110), (6, 90), (9, 98)], "validated_then_faded", "recovery_attempt", "investigate"),
        "H": ([(0, 100), (30, 100)], "inconclusive", "post_event_fade", "investigate"),
        "I": ([(2, 100), (9, 104)], "pending", "continuation", "watch"),
        "J": ([(-3, 100)], "insufficient_data", "insufficient_data", "insufficient_data"),
    }
    event = dt.date(2024, 3, 1)
    bars = [(s, event + dt.timedelta(days=k), float(c)) for s, (rows, *_) in cases.items() for k, c in rows]
    bars += [("A", event - dt.timedelta(days=k), c) for k, c in ((40, 50.0), (26, 90.0), (24, 91.0), (20, 92.0), (12, 93.0), (6, 96.0), (2, 97.0))]
    b = spark.createDataFrame(bars, "symbol string, d date, close double")
    got = {r.symbol: r for r in E.lifecycle(spark.createDataFrame([(s, event) for s in cases], "symbol string, d date"), b).collect()}
    assert {s: (r.outcome, r.phase, r.action) for s, r in got.items()} == {s: c[1:] for s, c in cases.items()}
    assert got["A"].episode_start == event - dt.timedelta(days=26) and abs(got["A"].since_episode - (115 / 90 - 1)) < 1e-12
    assert got["B"].episode_start == event and got["B"].since_episode == got["B"].since


def test_hit_labels(spark):
    import datetime as dt

    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    paths = {"up": [100, 111, 121], "mid": [100, 111, 112], "fell": [100, 89, 125], "after": [100, 130, 89], "late": [100] + [101] * 20 + [150], "end": [100]}
    b = spark.createDataFrame([(s, day(k), float(c)) for s, cs in paths.items() for k, c in enumerate(cs)], "symbol string, d date, close double")
    got = {r.symbol: (r.hit_10, r.hit_20) for r in E.forward_outcomes(b, b).filter(F.col("d") == F.lit(day(0))).collect()}
    assert got == {"up": (True, True), "mid": (True, False), "fell": (False, False), "after": (False, False), "late": (False, False), "end": (None, None)}
