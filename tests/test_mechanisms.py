"""Exact quantiles, merged intervals, gates and the stored stream against plain loops."""

import datetime as dt
import random
import statistics
import uuid

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tideline.operators import gates as G
from tideline.operators import intervals as IV
from tideline.operators import selection as Q
from tideline.sources import tape as S
from tideline.sources import views as V

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def write(spark, tmp_path):
    """Stores a table and reads it back, as the gates' rounds need: they join tables with themselves."""
    return lambda df: spark.read.schema(df.schema).parquet(stored(df, str(tmp_path / uuid.uuid4().hex)))


def stored(df, path):
    df.write.parquet(path)
    return path


def plain_quantile(values, p):
    x = sorted(values)
    at = p * (len(x) - 1)
    lo = int(at)
    hi = min(lo + (at > lo), len(x) - 1)
    return x[lo] + (x[hi] - x[lo]) * (at - lo)


@pytest.mark.parametrize("enough", [5, 40, 10**6])
def test_quantiles_are_exact(spark, enough, monkeypatch):
    rng = random.Random(enough)
    groups = {"a": [rng.gauss(0, 5) for _ in range(4000)], "b": [float(rng.randrange(4)) for _ in range(2000)], "c": [1.5] * 300, "d": [2.0], None: [rng.random() for _ in range(700)] + [-1e300, 1e300]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = [0.0, 0.01, 0.2, 0.5, 0.77, 1.0]
    got = {(r.k, r.p): r.q for r in Q.exact_quantiles(df, "v", probs, by=["k"], enough=enough).collect()}
    assert set(got) == {(k, p) for k in groups for p in probs}
    for (k, p), q in got.items():
        assert q == pytest.approx(plain_quantile(groups[k], p), rel=1e-12), (k, p)
    every = [v for vs in groups.values() for v in vs]
    assert [r.q for r in Q.exact_quantiles(df, "v", [0.5], enough=enough).collect()] == [pytest.approx(statistics.median(every))]
    assert Q.exact_quantiles(df.limit(0), "v", [0.5]).count() == 0
    monkeypatch.setattr(Q, "FEW_GROUPS", 1)
    again = {(r.k, r.p): r.q for r in Q.exact_quantiles(df, "v", probs, by=["k"], enough=enough).collect()}
    assert again == got


def test_intervals_merge_and_overlap(spark):
    rng = random.Random(3)
    gaps = [(rng.choice(["x", "y", None]), a, a + rng.choice([0, 5, 900, 200_000])) for a in (rng.randrange(3_000_000) for _ in range(150))] + [("x", 50, 40), ("x", None, 3), ("y", 7, 7), ("y", 7, 7)]
    spans = [(i, rng.choice(["x", "y", "z", None]), a, a + rng.choice([0, 60, 40_000, 500_000])) for i, a in enumerate(rng.randrange(3_000_000) for _ in range(400))]
    g, s = spark.createDataFrame(gaps, "k string, a long, b long"), spark.createDataFrame(spans, "i int, k string, a long, b long")
    runs = [tuple(r) for r in IV.merged(g, by="k").collect()]
    valid = [(k, a, b) for k, a, b in gaps if a is not None and a <= b]
    for k in ("x", "y", None):
        own = sorted((a, b) for x, a, b in runs if x == k)
        assert all(b < c for (_, b), (c, _) in zip(own, own[1:]))
        want = []
        for a, b in sorted((a, b) for x, a, b in valid if x == k):
            if want and a <= want[-1][1]:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
        assert [list(o) for o in own] == want
    for open_end in (False, True):
        got = {r.i: r.overlaps for r in IV.overlapping(s, g, by="k", open_end=open_end).collect()}
        assert got == {i: any(x == k and c <= b and (d > a if open_end else d >= a) and (c < d or not open_end) for x, c, d in valid) for i, k, a, b in spans}
    assert not any(r.overlaps for r in IV.overlapping(s, g.limit(0), by="k").collect())


def choose(times, gap):
    out = []
    for t in sorted(set(times)):
        if not out or (t - out[-1]).total_seconds() >= gap:
            out.append(t)
    return out


def test_a_tape_that_never_pauses(spark, write):
    """One key whose times are never a gap apart: hundreds of choices in one run."""
    rng = random.Random(8)
    at = [0]
    while len(at) < 2500:
        at.append(at[-1] + rng.randrange(1, 400))
    rows = [("n", DAY + dt.timedelta(seconds=t)) for t in at] + [("m", DAY), ("m", DAY), (None, DAY + dt.timedelta(hours=3))]
    got = sorted((r.k or "", r.ts) for r in G.spaced(spark.createDataFrame(rows, "k string, ts timestamp"), ["k"], 900, write).collect())
    want = sorted([("n", t) for t in choose([t for k, t in rows if k == "n"], 900)] + [("m", DAY), ("", DAY + dt.timedelta(hours=3))])
    assert got == want and len(got) > 400


def test_throttle_equals_a_state_machine(spark, write):
    rng = random.Random(2)
    rows, t = [], DAY
    for _ in range(500):
        t += dt.timedelta(minutes=rng.randrange(1, 200))
        rows.append((rng.choice("ab"), t, rng.choice(["warn", "warn", "page"]), rng.choice(["p", "p", "p", "q"])))
    want, state = [], {}
    for s, t, sev, pay in rows:
        last = state.get(s)
        if last is None or last[1:] != (sev, pay) or (t - last[0]).total_seconds() >= 6 * 3600:
            want.append((s, t, sev, pay))
            state[s] = (t, sev, pay)
    got = G.throttled(spark.createDataFrame(rows, "symbol string, ts timestamp, severity string, payload string"), 6 * 3600, write)
    assert sorted((r.symbol, r.ts, r.severity, r.payload) for r in got.collect()) == sorted(want)
    assert any(x[2:] == y[2:] for x, y in zip([w for w in want if w[0] == "a"], [w for w in want if w[0] == "a"][1:]))


def test_cooldown_spares_held_positions(spark, write):
    hour = lambda h: DAY + dt.timedelta(hours=h)
    micros = lambda h: int(hour(h).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    signals = spark.createDataFrame([("s", "buy", hour(h)) for h in (0, 1, 4, 5, 8, 9)] + [("s", "sell", hour(1))], "symbol string, side string, ts timestamp")
    held = spark.createDataFrame([("s", "buy", micros(3), micros(5)), ("s", "sell", micros(2), micros(9)), ("t", "buy", micros(0), micros(99))], "symbol string, side string, a long, b long")
    got = {(r.side, r.ts) for r in G.cooled(signals, held, 4 * 3600, write).collect()}
    # 4 falls away as the position is held; at 5 it is free again, and 8 is too soon after it
    assert got == {("buy", hour(0)), ("buy", hour(5)), ("buy", hour(9)), ("sell", hour(1))}


def test_stored_stream_survives_a_failure_between_batches(spark, tmp_path):
    ticks = V.ticks(spark, SF).select("symbol", "ts", "event_id", "price")
    ticks.repartition(6).write.parquet(str(tmp_path / "tape"))
    stream = lambda: S.tape_stream(spark, str(tmp_path / "tape"), ticks.schema, files=1)
    out, seen = str(tmp_path / "out"), []

    def failing(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen.append(number)
        if number == 2:
            raise RuntimeError("lost after the batch was stored, before its end was recorded")

    query = stream().writeStream.foreachBatch(failing).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost after"):
        query.awaitTermination()
    assert seen == [0, 1, 2]
    S.store_batches(stream(), out, str(tmp_path / "cp")).awaitTermination()
    got = S.stored_batches(spark, out, ticks.schema)
    assert got.count() == ticks.count() and got.exceptAll(ticks).count() == 0
    S.store_batches(stream(), out, str(tmp_path / "cp")).awaitTermination()  # nothing new
    assert S.stored_batches(spark, out, ticks.schema).count() == ticks.count()


def test_quotes_in_texts(spark, monkeypatch):
    import re
    import unicodedata

    from tideline.operators import quotes as QT

    def plain(text):
        text = unicodedata.normalize("NFKD", text)
        for a, b in zip("‘’“”", "''\"\"", strict=True):
            text = text.replace(a, b)
        return re.sub(r"\s+", " ", text).strip().lower()

    odd = ["Café  d’Été oﬃce ½", "ǖ … ça\tva bien “Oui”", "plain", "", "x́   y"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", QT.normalised(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: plain(t) for i, t in enumerate(odd)}
    rng = random.Random(6)
    words = "the cat déjà vu sat on a mat ‘so’ they say".split()
    docs = [(i if i else None, " \n".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(60)] + [(5, "the cat sat on the mat again and again"), (99, None)]
    quotes = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))) for i in range(150)] + [(900, "cat sat  ON the mat"), (901, "at sat on the ma"), (902, "again and again"), (903, "short"), (904, None), (905, "gain and agai"), (906, "deja vu sat o"), (907, "mat again and")]
    want = {(q, d) for q, s in quotes for d, t in docs if s and len(s) >= 10 and t is not None and plain(s) in plain(t)}
    q, d = spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(docs, "doc_id int, text string")
    for most in (10**6, 3):
        monkeypatch.setattr(QT, "MOST_KEYS", most)
        assert sorted(map(repr, (tuple(r) for r in QT.find(q, d).collect()))) == sorted(map(repr, want))
    assert len(want) > 30 and (901, 5) in want and QT.find(q.limit(0), d).count() == 0 and QT.find(q, d.limit(0)).count() == 0


def test_business_days_like_numpy(spark):
    import numpy as np

    from tideline.operators import decisions as D

    rng = random.Random(1)
    first = dt.date(2024, 1, 1)
    days = [first + dt.timedelta(days=rng.randrange(200)) for _ in range(80)] + [None]
    holidays = sorted({first + dt.timedelta(days=rng.randrange(260)) for _ in range(40)} | {first + dt.timedelta(days=k) for k in range(100, 125)})
    d, h = spark.createDataFrame([(i, x) for i, x in enumerate(days)], "i int, day date"), spark.createDataFrame([(x,) for x in holidays + holidays[:3]], "day date")
    for n in (0, 1, 10):
        got = {r.i: r.then for r in D.busday_add(d, "day", n, h, name="then").collect()}
        assert got == {i: np.busday_offset(np.datetime64(x), n, roll="forward", holidays=holidays).astype(object) if x else None for i, x in enumerate(days)}
    assert D.busday_add(d.limit(0), "day", 1, h, name="then").count() == 0 and D.busday_add(d, "day", 1, h.limit(0), name="then").count() == len(days)


def test_stalls_need_a_peer_that_moves(spark):
    from tideline.operators import tape as T

    at = lambda h: DAY + dt.timedelta(hours=h)
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    now, expected = frame([(at(10),)], "now timestamp"), frame([("a",), ("b",), ("gone",)], "symbol string")
    beats = [("a", at(10), 9), ("b", at(9), 5), ("c", at(6), 7), ("d", at(10), 3)]
    states = lambda before: {r.symbol: r.state for r in T.stalls(frame(beats, "symbol string, ts timestamp, rows long"), frame(before, "symbol string, rows long"), expected, now, interval_seconds=3600).collect()}
    assert states([("a", 8), ("b", 5), ("c", 1)]) == {"a": "fresh", "b": "stalled", "c": "stale", "d": "fresh", "gone": "missing"}
    assert states([("a", 9), ("b", 5), ("c", 1)]) == {"a": "fresh", "b": "fresh", "c": "stale", "d": "fresh", "gone": "missing"}
    assert states([]) == {"a": "fresh", "b": "fresh", "c": "stale", "d": "fresh", "gone": "missing"}


def test_quotes_in_a_long_text_take_time_by_its_words(spark):
    import time

    from tideline.operators import quotes as QT

    text = " ".join(f"mot{i}é" for i in range(30_000))
    d = spark.createDataFrame([(1, text)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "mot77é mot78é mot79é"), (2, "mot29998é mot29999é"), (3, "mot1é mot3é mot4é")], "quote_id int, quote string")
    began = time.time()
    assert sorted(r.quote_id for r in QT.find(q, d).collect()) == [1, 2] and time.time() - began < 40


def test_rounds_of_a_gate_shrink(spark, write):
    """On a tape that never pauses only the entries of ever longer blocks go on to the next round."""
    sizes = []

    def counted(df):
        out = write(df)
        if out.columns == ["_who", "_when", "_next"]:
            sizes.append(out.count())
        return out

    rows = [("a", DAY + dt.timedelta(seconds=10 * i)) for i in range(4000)]
    got = sorted(r.ts for r in G.spaced(spark.createDataFrame(rows, "k string, ts timestamp"), ["k"], 900, counted).collect())
    assert got == [DAY + dt.timedelta(seconds=900 * i) for i in range(45)]
    assert sizes[0] > 3800 and sum(sizes) < 3 * sizes[0]


def test_forward_as_of_goes_through_a_stretch_once(spark):
    """A frame up to a stretch's end is gone through anew for each row: 20,000 signals of one day took 200 million steps."""
    from tideline.operators import joins as J

    rng = random.Random(3)
    left = [(rng.choice(["a", "b", None]), DAY + dt.timedelta(minutes=rng.randrange(6000))) for _ in range(300)] + [("a", None)]
    right = sorted({(rng.choice(["a", None]), DAY + dt.timedelta(minutes=rng.randrange(5000))) for _ in range(60)}, key=repr)
    a, b = spark.createDataFrame(left, "k string, t timestamp"), spark.createDataFrame([(*r, i) for i, r in enumerate(right)], "k string, u timestamp, n int")
    got = J.asof_join(a, b, by="k", left_t="t", right_t="u", values=["n"], forward=True)
    want = [(k, t, min((u for m, u in right if m == k and t and u >= t), default=None)) for k, t in left if t]
    assert sorted(map(repr, ((r.k, r.t, r.match_t) for r in got.collect() if r.t))) == sorted(map(repr, want))
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_intervals_in_microseconds(spark):
    """Stretches of any width give the same; on microseconds the default would make one of nearly every row."""
    rng = random.Random(4)
    spans = [(i, rng.choice(["a", None]), x, x + rng.randrange(5)) for i in range(200) for x in [rng.randrange(400)]] + [(200, "a", 3, None), (201, "a", 3, 3), (202, "a", 3, 3)]
    gaps = [(rng.choice(["a", None]), x, x + rng.randrange(1, 6)) for x in rng.sample(range(400), 40)]
    s, g = spark.createDataFrame(spans, "i int, k string, a long, b long"), spark.createDataFrame(gaps, "k string, a long, b long")
    want = {i: b is not None and any(m == k and c < d and c <= b and d - 1 >= a for m, c, d in gaps) for i, k, a, b in spans}
    for width in (1, 7, 65_536):
        got = IV.overlapping(s, g, by="k", open_end=True, width=width)
        assert {r.i: r.overlaps for r in got.collect()} == want and got.columns == ["i", "k", "a", "b", "overlaps"]


def test_quotes_are_searched_in_one_pass_over_the_texts(spark, monkeypatch):
    """No rows by word: texts meet all quotes of a block at once, part by part. Quotes of every length, at the edges of parts and texts."""
    from tideline.operators import quotes as QT

    rng = random.Random(9)
    docs = [(i, "".join(rng.choice("abc ñ") for _ in range(rng.choice([0, 7, 40, 300])))) for i in range(40)] + [(3, "one more text of the third"), (50, None), (51, " " * 12)]
    cut = lambda t: t[(a := rng.randrange(len(t) + 1)) : a + rng.choice([10, 12, 15, 16, 17, 31, 32, 33, 64, 90])]
    quotes = [(i, cut(docs[i % 40][1])) for i in range(160)] + [(i, cut(docs[i % 40][1]).replace("a", "b", 1)) for i in range(160, 200)] + [(200, "more  text"), (201, " " * 12), (202, "         ab"), (0, "one more text"), (None, "one more text")]
    plain = lambda s: " ".join(s.split())
    want = {(q, d) for q, s in quotes for d, t in docs if len(s) >= 10 and t is not None and plain(s) in plain(t)}
    q, d = spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(docs, "doc_id int, text string")
    for part in (1 << 18, 32):
        monkeypatch.setattr(QT, "PART", part)
        found = QT.find(q, d)
        assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want))
    assert len(want) > 100 and (201, 51) in want and "Generate" not in found._jdf.queryExecution().executedPlan().toString()
