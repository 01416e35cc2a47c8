"""Operators of rules, exits and nulls against plain loops, and on empty and odd tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tideline.operators import discovery as X
from tideline.operators import gates as G
from tideline.operators import evidence as EV
from tideline.operators import intraday as I

MARKS = "symbol string, t long, high double, low double, close double, vol double, path int"


def walks(seed):
    rng, rows = random.Random(seed), []
    for sym in ("a", "b"):
        for t in range(400):
            if rng.random() > 0.1:
                c = 100 + 10 * rng.random()
                rows.append((sym, t * 60, c + rng.random(), c - rng.random(), c, 0.02, 7))
    return rows


def test_continuation_stops_at_a_gap(spark):
    rows = walks(1)
    at = {(r[0], r[1]): r for r in rows}
    got = X.continuation(spark.createDataFrame(rows, MARKS).drop("path"), cap=5, step=60).select("symbol", "t", F.expr("transform(path, b -> b.close)").alias("p")).collect()
    assert len(got) == len(rows)
    for g in got:
        want = []
        while len(want) < 5 and (g.symbol, g.t + 60 * (len(want) + 1)) in at:
            want.append(at[g.symbol, g.t + 60 * (len(want) + 1)][4] / at[g.symbol, g.t][4])
        assert g.p == want


def plain_trip(path, vol, tp, sl, cap):
    for b in path:
        if b.k > cap:
            return None
        if sl is not None and b.low <= 1 - sl * vol:
            return b.k, "stop"
        if tp is not None and b.high >= 1 + tp * vol:
            return b.k, "target"
        if b.k == cap:
            return b.k, "time_cap"
    return None


def test_exits_equal_a_loop(spark):
    x = X.continuation(spark.createDataFrame(walks(2), MARKS).drop("path"), cap=6, step=60)
    cells = [(tp, sl, cap) for cap in (3, 6) for tp in (None, 1.0, 3.0) for sl in (None, 2.0)]
    got = {(r.symbol, r.t, r.exit): (r.k, r.reason) for r in X.exit_scores(x, X.exit_grid([1.0, 3.0], [2.0], [3, 6])).collect()}
    want = {(r.symbol, r.t, i): plain_trip(r.path, r.vol, *c) for r in x.collect() for i, c in enumerate(cells)}
    assert got == {k: v for k, v in want.items() if v} and len({v[1] for v in got.values()}) == 3


def test_positions_rank_and_permuted_is_a_permutation(spark):
    x = spark.range(500).select(F.col("id").cast("string").alias("key"), F.col("id").cast("double").alias("v"))
    ranked = X.positions(x.withColumns({"p": F.lit(1), "h": F.md5(F.col("key").cast("binary"))}), "p", "h", digits=1).orderBy("h").collect()
    assert [r["at"] for r in ranked] == list(range(1, 501))
    shuffled = X.permuted(x, permutations=3).collect()
    for p in range(3):
        assert sorted(r.shuffled[p] for r in shuffled) == [float(i) for i in range(500)]
        assert [r.shuffled[p] for r in shuffled] != [r.v for r in shuffled]


def test_search_finds_the_planted_rule(spark):
    rng, values, atoms = random.Random(3), [], []
    for i in range(400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        values.append((str(i), float(a) + float(a and b) * 3 + rng.random() / 10))
        atoms += [(str(i), "x", f"x {'>' if a else '<'} 1"), (str(i), "y", f"y {'>' if b else '<'} 1"), (str(i), "z", f"z {'>' if rng.random() < 0.5 else '<'} 1")]
    v, at = spark.createDataFrame(values, "key string, v double"), spark.createDataFrame(atoms, "key string, feature string, atom string")
    found = X.depth_search(v, at, v, lambda df: df, depth=2, permutations=10).collect()
    rules = {(r.depth, r.rule): r for r in found}
    assert (1, "x > 1") in rules and (2, "x > 1 & y > 1") in rules and (1, "z > 1") not in rules
    want = [x for k, x in values if {(k, "x", "x > 1"), (k, "y", "y > 1")} <= set(atoms)]
    assert rules[2, "x > 1 & y > 1"].n == len(want) and abs(rules[2, "x > 1 & y > 1"].edge - sum(want) / len(want)) < 1e-9
    assert X.depth_search(v.limit(0), at.limit(0), v, lambda df: df, depth=2, permutations=3).count() == 0


def test_confirmation_verdicts(spark):
    rows = [(1, 0.5)] * 40 + [(2, -0.1), (2, 0.1)] * 20 + [(3, 0.1)] * 5 + [(4, -0.1)] * 40 + [(5, 0.2), (5, 0.4)] * 20
    got = {r.rule: r.verdict for r in X.confirmation(spark.createDataFrame(rows, "rule int, v double"), {5: 0.2}, promoted=[4, 5]).collect()}
    assert got == {1: "promote", 2: "reject", 3: "wait", 4: "decayed", 5: "kept"}


def test_spaced_equals_a_loop(spark, tmp_path):
    number = iter(range(10**6))

    def write(df):
        path = str(tmp_path / str(next(number)))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=rng.randrange(80_000))) for k in "ab" for _ in range(300)]
    got = sorted(map(tuple, G.spaced(spark.createDataFrame(rows + rows[:9], "k string, ts timestamp"), ["k"], 900, write).collect()))
    want, last = [], {}
    for k, ts in sorted(rows):
        if k not in last or (ts - last[k]).total_seconds() >= 900:
            last[k] = ts
            want.append((k, ts))
    assert got == want
    assert G.spaced(spark.createDataFrame([], "k string, ts timestamp"), ["k"], 900, write).count() == 0


def test_evidence_takes_nulls_and_any_case(spark):
    rows = [("earnings", None, "no_financial_metrics"), ("guidance", "OUTLOOK RAISED", ""), ("management_change", "The Vice President left", "weak_management_change"), (None, "x", ""), ("management_change", "Executive Chairman named", "routine_chair_appointment")]
    x = spark.createDataFrame(rows, "kind string, quote string, want string")
    assert x.filter(EV.weakness(F.col("kind"), F.col("quote")) != F.col("want")).count() == 0
    assert EV.insights(spark.createDataFrame([], "tier string, useful double, flaw string, lacks string, rejected boolean, ret double"), spark.createDataFrame([], "source string, failed boolean")).count() == 0


def test_book_window_leaves_out_absent_levels(spark):
    rows = [("s", dt.datetime(2024, 1, 1, 1), 1, "bid", [(10.0, 1.0), (9.0, 2.0), (8.0, 4.0)]), ("s", dt.datetime(2024, 1, 1, 2), 2, "bid", [(10.0, 3.0)])]
    got = {r.level: r for r in I.book_window(spark.createDataFrame(rows, "symbol string, ts timestamp, event_id long, side string, ladder array<struct<price: double, qty: double>>"), "6 hours").collect()}
    assert set(got) == {0, 2, 3} and (got[0].qty_min, got[0].qty_max, got[0].notional_max, got[0].samples) == (3.0, 7.0, 60.0, 2) and got[3].qty_last == 4.0


def test_only_keys_with_features_are_permuted(spark):
    """40 keys of which 20 have features: the others' values, all far above, never reach the bar; a key with features but no atom does."""
    v = spark.createDataFrame([(f"k{i:02d}", float(i)) for i in range(40)], "key string, v double")
    have = v.filter("v < 20")
    at = have.filter("v < 19").select("key", F.lit("f").alias("feature"), F.when(F.col("v") < 10, "low").otherwise("high").alias("atom"))
    held = {r.key for r in at.collect()}
    moved = X.permuted(X.pool(v, have), permutations=5).collect()
    assert {r.key for r in moved} == {f"k{i:02d}" for i in range(20)} and "k19" not in held
    assert all(sorted(r.shuffled[p] for r in moved) == [float(i) for i in range(20)] for p in range(5))
    found = X.depth_search(v, at, have, lambda df: df, depth=1, permutations=20, quantile=0.0, min_firing=1).collect()
    whole = X.depth_search(v, at, v, lambda df: df, depth=1, permutations=20, quantile=0.0, min_firing=1).collect()
    assert [r.rule for r in found] == ["high"] and found[0].null_bar < 14 and not whole
