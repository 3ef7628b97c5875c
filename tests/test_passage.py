"""The first bar under a level against a loop over all sessions."""

import datetime
import random

import pytest

from tidepanel.operators import outcomes as op

DAY = datetime.date(2020, 1, 6)


@pytest.mark.parametrize("horizon", [1, 5, 30, 250])
def test_first_passage_by_a_plain_loop(spark, horizon):
    rng = random.Random(horizon)
    bars = {(s, i): (round(50 + rng.gauss(0, 20), 1), 60.0) for s in range(3) for i in range(300) if rng.random() < 0.9}
    frame = spark.createDataFrame([(s, i, o, low) for (s, i), (low, o) in bars.items()], "symbol long, idx long, open double, low double")
    asked = [(rng.randrange(4), a, a + rng.randint(1, horizon), rng.choice([-20.0, 0.0, 10.0, 30.0, None]), k) for k in range(400) for a in [rng.randrange(-3, 310)]]
    rows = spark.createDataFrame(asked, "symbol long, a long, b long, level double, k long")
    got = {r["k"]: r["hit"] and r["hit"]["i"] for r in op.first_passage(rows, frame, "a", "b", "level", horizon).collect()}
    want = {k: next((i for i in range(a + 1, b + 1) if (s, i) in bars and level is not None and bars[s, i][0] <= level), None) for s, a, b, level, k in asked}
    assert got == want


def test_outcomes_by_a_plain_loop(spark):
    """Gaps, several windows, stops, the end of the calendar; every order in which they can meet."""
    rng = random.Random(3)
    day = lambda i: DAY + datetime.timedelta(7 * i)
    bars = {(s, i): (c, c - rng.random() * 8, round(c + rng.gauss(0, 3), 2)) for s in range(4) for i in range(120) if rng.random() < 0.97 for c in [100 + rng.gauss(0, 4)]}
    events = [(s, i, i + rng.randint(0, 2)) for s in range(4) for i in rng.sample(range(120), 5)]
    frame = spark.createDataFrame([(s, i, day(i), o, low, c) for (s, i), (c, low, o) in bars.items()], "symbol long, idx long, session date, open double, low double, close double")
    ledger = spark.createDataFrame([(s, day(a), day(b)) for s, a, b in events], "symbol long, impact_start date, impact_end date")
    signals = [(s, i, 0.08 if i % 2 else 0.03) for s in range(4) for i in range(0, 119)]
    last = spark.createDataFrame([(119,)], "last long")
    h = 12
    out = op.trade_outcomes(spark.createDataFrame(signals, "symbol long, idx long, stop double"), frame, ledger, h, op.F.col("stop"), 0.001, 0.002, last)
    got = {(r["symbol"], r["idx"]): (r["status"], r["exit_idx"], r["net"] and round(r["net"], 9)) for r in out.collect()}
    for s, i, stop in signals:
        entry, plan = i + 1, i + 1 + h
        price, kind = bars.get((s, entry), (None,))[0], None
        for at in range(entry + 1, plan + 1):
            bar = bars.get((s, at))
            if bar and any(x == s and a <= at <= b for x, a, b in events):
                kind, paid = "event", None
            elif not bar:
                kind, paid = "gap", None
            elif price is not None and bar[1] <= price * (1 - stop):
                kind, paid = "stop", min(bar[2], price * (1 - stop))
            elif at == plan:
                kind, paid = "plan", bar[0]
            if kind:
                break
        if price is None and entry <= 119:
            want = ("missing_price", None, None)
        elif plan > 119 and kind != "stop":
            want = ("immature", None, None)
        elif kind in ("event", "gap"):
            want = ({"event": "corporate_action", "gap": "missing_price"}[kind], None, None)
        else:
            want = ("complete", at, round(paid * (0.999 * 0.998) / (price * (1.001 * 1.002)) - 1, 9))
        assert got[s, i] == (want[0], want[1], want[2] if want[2] is None else pytest.approx(want[2], abs=1e-9)), (s, i)
    assert {x[0] for x in got.values()} == {"complete", "immature", "missing_price", "corporate_action"}
